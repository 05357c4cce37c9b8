"""A data source for trees of files on a file system that every executor has mounted: ``spark.read.format("corpus_tree")``.

Directories are pruned while they are listed: what is skipped, too deep, or on the way to no target is never opened. Filters
on ``path`` (equal, in, starts with) are taken as targets where the session pushes filters to Python sources
(``spark.sql.python.filterPushdown.enabled``). Files are dealt to tasks by size, largest first. A link that leads out of the
root is listed with the reason ``outside`` and never read.

Other stores, which only Spark reads, go through ``files.scan_files``.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from corpusloom import model
from corpusloom.errors import CorpusError
from corpusloom.functions.text import glob_to_regex
from corpusloom.sources.files import contained

SCHEMA = "path string, name string, size long, mtime timestamp, text string, reason string"
#: Bytes of files that one task reads at least, and the most tasks.
TASK_BYTES, MOST_TASKS = 64 << 20, 10_000
#: Bytes of texts that a task holds before it sends them on.
SENT_BYTES = 4 << 20


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    mtime: float
    outside: bool


@dataclass
class Listing:
    """The files below ``root`` and how many directories were opened to find them."""

    root: str
    dirs: frozenset[str] = frozenset(model.PRUNED_DIRECTORIES)
    globs: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    depth: int | None = None
    opened: int = 0
    _globs: list[re.Pattern] = field(default_factory=list)

    def _skipped(self, path: str, name: str) -> bool:
        return name in self.dirs or any(g.match(path) or g.match(name) for g in self._globs)

    def _wanted(self, path: str, is_dir: bool) -> bool:
        """Whether a path is at or below a target; for a directory, also whether it leads to one."""
        if not self.targets:
            return True
        return any(path == t or path.startswith(f"{t}/") or is_dir and t.startswith(f"{path}/") for t in self.targets)

    def files(self) -> Iterator[Found]:
        self._globs = [re.compile(glob_to_regex(g).replace(r"\z", r"\Z")) for g in self.globs]
        top = os.path.realpath(self.root)
        if not os.path.isdir(top):
            raise CorpusError("path", "there is no such directory", what=self.root)
        waiting, seen = [("", top, 1)], {top}
        while waiting:
            below, place, level = waiting.pop()
            self.opened += 1
            with os.scandir(place) as entries:
                for entry in sorted(entries, key=lambda e: e.name):
                    path = f"{below}{entry.name}"
                    if self._skipped(path, entry.name):
                        continue
                    real = os.path.realpath(entry.path) if entry.is_symlink() else entry.path
                    inside = real == top or real.startswith(f"{top}/")
                    is_dir = inside and os.path.isdir(real)
                    if not self._wanted(path, is_dir):
                        continue
                    if is_dir:
                        # A link back up would go round for ever: a directory is listed once.
                        if (self.depth is None or level < self.depth) and not (entry.is_symlink() and real in seen):
                            seen.add(real)
                            waiting.append((f"{path}/", real, level + 1))
                        continue
                    if not inside:
                        yield Found(path, 0, entry.stat(follow_symlinks=False).st_mtime, True)
                    elif os.path.isfile(real):
                        stat = os.stat(real)
                        yield Found(path, stat.st_size, stat.st_mtime, False)


@dataclass
class Share(InputPartition):
    """The files that one task reads."""

    files: list[Found]


def dealt(files: Iterable[Found], task_bytes: int = TASK_BYTES, most: int = MOST_TASKS) -> list[Share]:
    """Files in shares of about equal bytes: the largest first, each to the lightest share."""
    ordered = sorted(files, key=lambda f: (-f.size, f.path))
    n = max(1, min(most, len(ordered), -(-sum(f.size for f in ordered) // task_bytes)))
    shares, heap = [Share([]) for _ in range(n)], [(0, k) for k in range(n)]
    for f in ordered:
        load, k = heapq.heappop(heap)
        shares[k].files.append(f)
        heapq.heappush(heap, (load + f.size, k))
    return shares


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.listing = Listing(
            options["path"].removeprefix("file:").replace("///", "/", 1) if options["path"].startswith("file:") else options["path"],
            frozenset(filter(None, options.get("dirs", ",".join(model.PRUNED_DIRECTORIES)).split(","))), tuple(filter(None, options.get("globs", "").split(","))),
            tuple(contained("", t).strip("/") for t in options.get("targets", "").split(",") if t), int(options["depth"]) if "depth" in options else None,
        )
        self.most_bytes = int(options.get("mostbytes", model.FILE_BYTES))
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.texts = options.get("texts", "true") == "true"

    def partitions(self) -> list[Share]:
        return dealt(self.listing.files(), self.task_bytes)

    def read(self, partition: Share) -> Iterator:
        """Batches of rows, each sent when its files reach ``SENT_BYTES``: Spark would gather 10,000 tuples, whatever they hold."""
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        held, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names)
        for row in self._rows(partition):
            held.append(row)
            size += row[2]
            if size >= SENT_BYTES:
                yield batch()
                held, size = [], 0
        yield batch()

    def _rows(self, partition: Share) -> Iterator[tuple]:
        from datetime import UTC, datetime

        for f in partition.files:
            text, reason = None, "outside" if f.outside else "too_large" if f.size > self.most_bytes else None
            if reason is None and self.texts:
                with open(f"{self.listing.root}/{f.path}", "rb") as file:
                    data = file.read()
                try:
                    text, reason = (None, "binary") if b"\0" in data else (data.decode(), None)
                except UnicodeDecodeError:
                    reason = "encoding"
            yield f.path, f.path.rpartition("/")[2], f.size, datetime.fromtimestamp(f.mtime, UTC), text, reason


class FilteredTreeReader(TreeReader):
    """The reader of sessions that push filters down; Spark refuses this method in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - Spark's name
        """Filters on the path become targets; Spark still applies them to the rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and not self.listing.targets:
                if isinstance(f, EqualTo):
                    self.listing.targets = (f.value,)
                elif isinstance(f, In):
                    self.listing.targets = tuple(f.value)
                elif isinstance(f, StringStartsWith) and "/" in f.value:
                    self.listing.targets = (f.value.rpartition("/")[0],)
            yield f


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        options = dict(self.options)
        return (FilteredTreeReader if options.pop("filters", "false") == "true" else TreeReader)(options)


def scan_tree(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """(path, name, size, mtime, text, reason) of the files below ``root``; options: dirs, globs, targets (comma-separated), depth, mostBytes, taskBytes, texts."""
    spark.dataSource.register(TreeSource)
    options |= {"filters": spark.conf.get("spark.sql.python.filterPushdown.enabled") == "true"}
    return spark.read.format("corpus_tree").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(root)
