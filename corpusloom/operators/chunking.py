"""Cutting files into bounded chunks."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import model
from corpusloom.errors import CorpusError
from corpusloom.functions.text import chunk_id, chunk_size, language
from corpusloom.operators.scopes import DEEPEST, TYPES, Scope, scopes_of
from corpusloom.sources.files import with_text


def size_fault(size: Column, overlap: Column, strict: bool = True) -> Column:
    """The code of what is wrong with a size and overlap, for requests that come as rows; null if nothing is."""
    low, high = (model.MIN_CHUNK, model.MAX_CHUNK) if strict else (1, 1 << 40)
    return F.when(~size.between(low, high), "chunk_size").when((overlap < 0) | (overlap > model.MAX_OVERLAP) | (overlap >= size), "overlap")


def check_sizes(size: int, overlap: int, strict: bool = True) -> None:
    low, high = (model.MIN_CHUNK, model.MAX_CHUNK) if strict else (1, 1 << 40)
    if not low <= size <= high:
        raise CorpusError("chunk_size", f"{size} is not within {low} to {high}", what="size")
    if not 0 <= overlap <= model.MAX_OVERLAP or overlap >= size:
        raise CorpusError("overlap", f"{overlap} does not fit a size of {size}", what="overlap")


def bounds(n: Column, size: Column, overlap: int = 0) -> Column:
    """array<struct<start, end>>; no chunk holds only what overlaps the one before."""
    last = F.greatest(n - overlap - 1, F.lit(0))
    step = size - overlap
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), step.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).cast("long").alias("end")))


def chunk_fixed(files: DataFrame, size: int = model.DEFAULT_CHUNK_SIZE, overlap: int = 0, strict: bool = True) -> DataFrame:
    """(path, no, start, end, content, chunk_id) of every chunk."""
    check_sizes(size, overlap, strict)
    return _cut(files, F.lit(size), overlap)


def chunk_adaptive(files: DataFrame, scale: int = 1) -> DataFrame:
    """Chunks sized by the file's type; ``scale`` divides the sizes, for small corpora."""
    return _cut(files, F.floor(chunk_size(F.col("ext")) / scale), 0)


def _cut(files: DataFrame, size: Column, overlap: int) -> DataFrame:
    rows = with_text(files).select("path", "text", F.posexplode(bounds(F.length("text"), size, overlap)).alias("no", "b"))
    content = F.substring("text", F.col("b.start").cast("int") + 1, (F.col("b.end") - F.col("b.start")).cast("int"))
    rows = rows.select("path", F.col("no").cast("long").alias("no"), "b.start", "b.end", content.alias("content"))
    return rows.withColumn("chunk_id", chunk_id(F.col("path"), F.col("start"), F.col("content")))


def chunk_limit(chunks: DataFrame) -> DataFrame:
    """(n_chunks, state): state is ok, warn above 100 chunks, refuse above 500."""
    n = F.count("*")
    state = F.when(n > model.MOST_CHUNKS, "refuse").when(n > model.WARN_CHUNKS, "warn").otherwise("ok")
    return chunks.agg(n.alias("n_chunks"), state.alias("state"))


def chunk_lines(files: DataFrame, size: int) -> DataFrame:
    """(path, no, n_lines, n_chars): whole lines, as many to a chunk as ``size`` characters hold; a longer line is a chunk."""
    rows = chunk_lines_overlapping(files, size, 0)
    n_lines = F.col("end_line") - F.col("start_line") + 1
    return rows.select("path", "no", n_lines.alias("n_lines"), (F.length("content") + 1).cast("long").alias("n_chars"))


def overlapping(findings: DataFrame, chunks: DataFrame, step: int) -> DataFrame:
    """``findings`` (path, start, end, ...) with the ``no`` and ``chunk_id`` of every chunk that they lie in or touch.

    Both sides are cut at multiples of ``step`` (about a chunk's size), so that intervals meet by equality; each
    pair is given where the later of the two begins.
    """
    cuts = lambda low, high: F.explode(F.sequence(F.floor(low / step), F.floor((F.greatest(high, low + 1) - 1) / step))).alias("cut")
    a = findings.select("*", cuts(F.col("start"), F.col("end")))
    b = chunks.select(F.col("path").alias("__path"), F.col("start").alias("__start"), F.col("end").alias("__end"), "no", "chunk_id", cuts(F.col("start"), F.col("end"))).withColumnRenamed("cut", "__cut")
    meet = (F.col("path") == F.col("__path")) & (F.col("cut") == F.col("__cut")) & (F.col("start") < F.col("__end")) & (F.col("__start") < F.col("end"))
    first = F.col("cut") == F.floor(F.greatest("start", "__start") / step)
    return a.join(b, meet).where(first).select(*[f"`{c}`" for c in findings.columns], "no", "chunk_id")


#: Characters of chunks that leave a Python worker together, and the most rows.
FRAME_CHARS, FRAME_ROWS = 1 << 20, 10_000


def frames(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of rows, each sent when its texts reach ``FRAME_CHARS``, so that a batch's chunks are never held together."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if size >= FRAME_CHARS or len(held) >= FRAME_ROWS:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    yield pd.DataFrame(held, columns=columns)


def line_chunks(text: str, size: int, overlap_lines: int) -> list[tuple[int, int, str]]:
    """(first line, last line, content): as many whole lines as fit, at least one, each chunk led by the lines before it."""
    lines = text.split("\n")
    ends = np.cumsum([len(line) + 1 for line in lines])
    out, at = [], 0
    while at < len(lines):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        first = max(at - overlap_lines, 0)
        out.append((first + 1, to, "\n".join(lines[first:to])))
        at = to
    return out


def chunk_lines_overlapping(files: DataFrame, size: int = model.DEFAULT_CHUNK_SIZE, overlap_lines: int = 5) -> DataFrame:
    """(path, no, start_line, end_line, content, is_fallback): whole lines, for files that have no scopes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = ((p, k, *c, True) for p, t in zip(pdf["path"], pdf["text"]) for k, c in enumerate(line_chunks(t or "", size, overlap_lines)))
            yield from frames(rows, ["path", "no", "start_line", "end_line", "content", "is_fallback"])

    return with_text(files).select("path", "text").mapInPandas(cut, "path string, no long, start_line long, end_line long, content string, is_fallback boolean")


def scopes_in(text: str, lang: str | None) -> list[Scope]:
    """The classes, functions and methods of a text with their lines and depth, 0 for the outermost, at most ``DEEPEST``: Python by its own parser, others by a lexer."""
    if lang != "python":
        return scopes_of(text, lang) if lang in TYPES else []
    try:
        inside = [(node, 0) for node in ast.parse(text).body]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    while inside:
        node, depth = inside.pop()
        is_scope = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and depth <= DEEPEST
        if is_scope:
            line = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append(Scope(line, depth, "class" if isinstance(node, ast.ClassDef) else "method" if depth else "function", node.name, node.end_lineno))
        inside += [(child, depth + is_scope) for child in ast.iter_child_nodes(node) if isinstance(child, ast.stmt | ast.match_case | ast.excepthandler)]
    return sorted(out)


def scopes(text: str, lang: str | None) -> dict[int, int]:
    """1-based first line -> depth of every class and function, 0 for the outermost."""
    out: dict[int, int] = {}
    for s in scopes_in(text, lang):
        out[s.line] = min(s.depth, out.get(s.line, s.depth))
    return out


def scope_starts(text: str, lang: str | None) -> list[int]:
    """1-based lines on which a class or function of the outermost level begins."""
    return sorted(line for line, depth in scopes(text, lang).items() if depth == 0)


def scope_chunks(text: str, lang: str | None, most: int) -> list[tuple[int, int, str, bool]]:
    """(first line, last line, content, is_fallback) of chunks of whole scopes up to ``most`` characters.

    Contents joined give the text. Chunks of half that size or more end where an outermost scope begins. A
    scope larger than ``most`` is cut where the last of its least deep inner scopes begins, and between lines where
    there is none; without scopes all chunks are such fallbacks. A longer line is a chunk.
    """
    lines = text.split("\n")
    lines = [line + "\n" for line in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    depth = scopes(text, lang)
    out: list[tuple[int, int, str, bool]] = []
    first, size = 0, 0

    def close(to: int, fallback: bool) -> None:
        nonlocal first, size
        out.append((first + 1, to, "".join(lines[first:to]), fallback))
        size -= sum(map(len, lines[first:to]))
        first = to

    for no, line in enumerate(lines):
        while first < no and size + len(line) > most:
            inner = [k - 1 for k in range(first + 2, no + 2) if k in depth]
            least = min((depth[k + 1] for k in inner), default=0)
            cut = max((k for k in inner if depth[k + 1] == least), default=no)
            close(cut, not inner)
        if first < no and depth.get(no + 1) == 0 and size >= most // 2:
            close(no, False)
        size += len(line)
    if first < len(lines):
        close(len(lines), not depth)
    return out


#: Characters of a chunk that stays within its tokens, at four characters a token.
SCOPE_CHARS = int(model.CHUNK_TOKENS * model.TOKEN_MARGIN) * 4


def chunk_scopes(files: DataFrame, most: int = SCOPE_CHARS) -> DataFrame:
    """(path, no, start_line, end_line, content, is_fallback): chunks that end where scopes begin."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = ((p, k, *c) for p, t, lang in zip(pdf["path"], pdf["text"], pdf["lang"]) for k, c in enumerate(scope_chunks(t or "", lang, most)))
            yield from frames(rows, ["path", "no", "start_line", "end_line", "content", "is_fallback"])

    rows = with_text(files).select("path", "text", language(F.col("ext")).alias("lang"))
    return rows.mapInPandas(cut, "path string, no long, start_line long, end_line long, content string, is_fallback boolean")


def extract_scopes(files: DataFrame) -> DataFrame:
    """(path, line, last_line, depth, kind, name) of every scope of the files (path, ext, text)."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = ((p, s.line, s.last, s.depth, s.kind, s.name) for p, t, lang in zip(pdf["path"], pdf["text"], pdf["lang"]) for s in scopes_in(t or "", lang))
            yield from frames(rows, ["path", "line", "last_line", "depth", "kind", "name"])

    rows = with_text(files).select("path", "text", language(F.col("ext")).alias("lang"))
    return rows.mapInPandas(found, "path string, line long, last_line long, depth long, kind string, name string")
