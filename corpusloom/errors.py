"""What the library refuses, as a table and as an exception."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: Process exit codes by kind of fault.
EXIT = {"argument": 2, "data": 3, "state": 4, "system": 1}

#: fault -> (kind, what went wrong, what to do about it)
FAULTS = {
    "pattern": ("argument", "pattern can't be used", "Write {what} without repeats inside repeats and without alternatives that start alike."),
    "path": ("argument", "path outside of its root", "Give {what} relative to the root, without `..`."),
    "session_name": ("argument", "name can't be a session's", "Use letters, digits, - and _ in {what}."),
    "query": ("argument", "no query", "Say what {what} asks for."),
    "chunk_size": ("argument", "chunk size out of range", "Choose {what} within the limits, or strict=False."),
    "many_chunks": ("argument", "too many chunks", "Choose a larger {what}, scan less, or force it."),
    "overlap": ("argument", "overlap doesn't fit", "Choose {what} below the chunk size and the largest overlap."),
    "setting": ("argument", "no such value", "Set {what} to one of the values that its documentation lists."),
    "columns": ("data", "columns missing or taken", "Add or rename the columns of {what}."),
    "too_many": ("data", "more rows than one document takes", "Export {what} as lines."),
    "structure_only": ("data", "texts were not loaded", "Scan {what} in full or by targets before reading texts."),
    "binary": ("data", "not a text", "Leave {what} out, or convert it to UTF-8."),
    "too_large": ("data", "file too large", "Cut {what} into parts, or allow more bytes."),
    "session_exists": ("state", "session exists", "Resume {what}, or replace it with force=True."),
    "no_session": ("state", "no such session", "List the sessions; {what} is not among them."),
    "unsettled": ("system", "components did not settle", "Allow more {what}."),
    "no_shared_folder": ("system", "no shared folder", "Set {what} to a folder that all executors reach."),
    "cancelled": ("system", "work was cancelled", "Resume {what}; batches that were written stay."),
}


def table(spark: SparkSession) -> DataFrame:
    """(code, kind, title, exit_code, hint), one row per fault."""
    rows = [(code, kind, title, EXIT[kind], hint) for code, (kind, title, hint) in FAULTS.items()]
    return spark.createDataFrame(rows, "code string, kind string, title string, exit_code int, hint string")


class CorpusError(Exception):
    """``[code] title: message`` with its context; unknown context fields are kept."""

    def __init__(self, code: str, message: str, **context: object):
        self.code = code
        self.kind, self.title, hint = FAULTS[code]
        self.exit_code = EXIT[self.kind]
        self.message, self.context = message, context
        self.hint = hint.format(what=context.get("what", "it"))
        super().__init__(f"[{self.code}] {self.title}: {message}")

    def to_json(self) -> str:
        return json.dumps({"code": self.code, "kind": self.kind, "title": self.title, "message": self.message, "hint": self.hint, "context": self.context}, default=str)
