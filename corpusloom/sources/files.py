"""Corpora as tables of files: scans, pruning, listings, headers and sinks."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import model
from corpusloom.errors import CorpusError
from corpusloom.functions.text import extension, format_size, glob_to_regex
from corpusloom.plans.running import running_sum
from corpusloom.plans.staging import file_system

#: Endings dealt to documents by id, so that tables of documents can stand for trees of files.
ENDINGS = (".py", ".md", ".json", ".txt", ".html", ".xml", ".csv", ".js")


def contained(root: str, path: str) -> str:
    """``path`` below ``root``; raises for absolute paths, ``..`` and NUL."""
    parts = PurePosixPath(path.replace("\\", "/"))
    if "\0" in path or parts.is_absolute() or ".." in parts.parts:
        raise CorpusError("path", "the path leaves its root", what=path)
    return f"{root.rstrip('/')}/{parts}"


def is_contained(path: Column) -> Column:
    """Whether a path stays below whatever root it is put under: as ``contained``, for paths that come as rows."""
    plain = F.translate(path, "\\", "/")
    return ~(plain.startswith("/") | F.array_contains(F.split(plain, "/"), "..") | F.contains(path, F.lit("\0")))


def scan_files(spark: SparkSession, root: str, most_bytes: int = model.FILE_BYTES, most_total: int | None = None) -> DataFrame:
    """(path, name, size, mtime, text, reason) of every file below ``root``; a file that isn't read has no text and a reason: too_large, binary (it holds NUL) or encoding."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("path", _relative(F.col("path"), root))
    if most_total is not None and (raw.agg(F.sum("length")).first()[0] or 0) > most_total:
        raise CorpusError("too_many", f"the files hold more than {most_total} bytes", what=root)
    held = F.col("content").cast("string")
    reason = F.when(F.col("length") > most_bytes, "too_large").when(F.contains(F.col("content"), F.lit(b"\0")), "binary").when(~F.is_valid_utf8(held), "encoding")
    rows = raw.withColumn("reason", reason).withColumn("text", F.when(F.col("reason").isNull(), held))
    return rows.select("path", _name(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "text", "reason")


def scan_full(spark: SparkSession, root: str, most_bytes: int = model.FILE_BYTES, most_total: int | None = None) -> DataFrame:
    """(path, name, size, mtime, text) of every readable text file below ``root``; ``scan_files`` also names the others."""
    return scan_files(spark, root, most_bytes, most_total).where("reason is null").drop("reason")


def scan_lazy(spark: SparkSession, root: str, depth: int | None = 3, most: int | None = 50) -> DataFrame:
    """(path, name, size, mtime): structure only, contents are never read. At most ``depth`` levels and ``most`` files, the first by path; None lifts a bound."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = _relative(F.col("path"), root)
    rows = raw.select(path.alias("path"), _name(path).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    rows = rows if depth is None else rows.where(F.size(F.split("path", "/")) <= depth)
    return rows if most is None else rows.orderBy("path").limit(most)


def with_text(files: DataFrame) -> DataFrame:
    """``files``, or an error where only their structure was scanned."""
    if "text" not in files.columns:
        raise CorpusError("structure_only", "the files were scanned without their texts", what="the files")
    return files


def scan_targeted(files: DataFrame, targets: list[str]) -> DataFrame:
    """Files at or below one of the targets; a file under several targets comes once."""
    cond = F.lit(False)
    for t in targets:
        t = t.strip("/")
        cond |= (F.col("path") == t) | F.col("path").startswith(f"{t}/")
    return files.where(cond)


def load_file(files: DataFrame, path: str, most_bytes: int = model.FILE_BYTES) -> DataFrame:
    """The row of one file, none if there is no such file; raises for a path that leaves the root, a text that holds NUL, and one larger than ``most_bytes``."""
    contained("", path)
    rows = with_text(files).where(F.col("path") == path)
    found = rows.agg(F.max(F.contains("text", F.lit("\0"))).alias("binary"), F.max(F.octet_length("text")).alias("size")).first()
    if found["binary"]:
        raise CorpusError("binary", "the file holds NUL", what=path)
    if (found["size"] or 0) > most_bytes:
        raise CorpusError("too_large", f"{found['size']} bytes, of which {most_bytes} are read", what=path)
    return rows


def _relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def documents_as_files(docs: DataFrame) -> DataFrame:
    """A table of documents as files: path from source, language and id, ending by id."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS)).cast("int") + 1)
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ending)
    return docs.select("doc_id", path.alias("path"), ending.alias("ext"), "source", "text", F.length("text").cast("long").alias("n_chars"))


def parse_ignore(lines: list[str]) -> tuple[list[str], list[str]]:
    """(directory names, globs) of an ignore file; ``#`` comments and blank lines are skipped."""
    rules = [s for line in lines if (s := line.strip()) and not s.startswith("#")]
    dirs = [r.strip("/") for r in rules if not set(r) & set("*?[")]
    return dirs, [r for r in rules if set(r) & set("*?[")]


def skipped(path: Column, dirs: tuple[str, ...] | list[str] = model.PRUNED_DIRECTORIES, globs: list[str] | None = None) -> Column:
    """Whether a path has a component among ``dirs``, or it or a component matches a glob."""
    parts = F.split(path, "/")
    out = F.arrays_overlap(parts, F.array(*map(F.lit, dirs))) if dirs else F.lit(False)
    for pattern in map(glob_to_regex, globs or []):
        out |= path.rlike(pattern) | F.exists(parts, _matches(pattern))
    return out


def _matches(pattern: str):
    return lambda part: part.rlike(pattern)


def prune(files: DataFrame, dirs: tuple[str, ...] | list[str] = model.PRUNED_DIRECTORIES, globs: list[str] | None = None) -> DataFrame:
    return files.where(~skipped(F.col("path"), dirs, globs))


def tree(files: DataFrame, depth: int = 3, most: int = model.TREE_ENTRIES) -> DataFrame:
    """(path, name, parent, is_dir, depth, size, files): directories and files, directories first, names without case."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = files.select(F.col("path").alias("file"), F.col("n_chars").alias("size"), F.explode(up).alias("path"))
    entries = rows.groupBy("path").agg(F.sum("size").cast("long").alias("size"), F.count("*").alias("files"), F.bool_or(F.col("path") != F.col("file")).alias("is_dir"))
    level = F.size(F.split("path", "/"))
    entries = entries.withColumn("depth", level.cast("long")).where(F.col("depth") <= depth)
    entries = entries.withColumn("name", _name(F.col("path"))).withColumn("parent", F.regexp_replace("path", "/?[^/]*$", ""))
    return entries.orderBy("parent", F.desc("is_dir"), F.lower("name"), "name").limit(most)


def tree_view(files: DataFrame, depth: int = 3, most: int = model.TREE_ENTRIES, sizes: bool = True) -> str:
    """The bounded listing as text; only the entries shown reach the driver."""
    shown = tree(files, depth, most).withColumn("shown", format_size(F.col("size"))).collect()
    below: dict[str, list] = {}
    for row in shown:
        below.setdefault(row["parent"], []).append(row)
    lines: list[str] = []

    def render(parent: str, lead: str) -> None:
        rows = below.get(parent, [])
        for i, row in enumerate(rows):
            last = i == len(rows) - 1
            label = row["name"] + ("/" if row["is_dir"] else "") + (f" ({row['shown']})" if sizes else "")
            lines.append(f"{lead}{'└── ' if last else '├── '}{label}")
            if row["is_dir"]:
                render(row["path"], lead + ("    " if last else "│   "))

    render("", "")
    n = sum(not r["is_dir"] for r in shown)
    return "\n".join([*lines, f"{n} files, {len(shown) - n} directories" + (", truncated" if len(shown) == most else "")])


def preview_dir(files: DataFrame, below: str, depth: int = 2, most: int = 30) -> str:
    """The listing of one directory, ``depth`` levels deep."""
    contained("", below)
    prefix = below.strip("/") + "/"
    inside = files.where(F.col("path").startswith(prefix)).withColumn("path", F.substring("path", len(prefix) + 1, 1 << 30))
    return tree_view(inside, depth, most)


def should_ignore(path: Column, globs: tuple[str, ...] = model.IGNORED_GLOBS) -> Column:
    """Whether a path or one of its components matches an ignore pattern."""
    return skipped(path, [], list(globs))


def with_headers(files: DataFrame) -> DataFrame:
    """Files with ``entry`` (header, text, footer) and its length ``size``."""
    entry = F.concat(F.lit("=== FILE: "), "path", F.lit(" ===\n"), "text", F.lit("\n"))
    return files.withColumn("entry", entry).withColumn("size", F.length("entry").cast("long"))


def entry_offsets(files: DataFrame) -> DataFrame:
    """(path, size, start): where each entry starts among all entries by directory and path. Texts aren't shuffled."""
    rows = with_headers(files).select("path", "size", F.regexp_extract("path", "^([^/]*/?)", 1).alias("dir"))
    order = [F.col("dir"), F.col("path"), F.col("size")]
    return running_sum(rows, F.col("size"), order, "through").select("path", "size", (F.col("through") - F.col("size")).alias("start"))


def context_metadata(files: DataFrame) -> DataFrame:
    return files.agg(F.sum("n_chars").cast("long").alias("total_size"), F.count("*").alias("file_count"), F.countDistinct(extension(F.col("path"))).alias("n_types"))


def write_chunks(chunks: DataFrame, out: str) -> None:
    """One folder per session."""
    chunks.write.partitionBy("session_id").parquet(out)


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(results, unreadable lines) of a file of JSON lines."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.from_json("value", model.CHUNK_RESULT, {"mode": "PERMISSIVE"}).alias("r"))
    good = F.col("r.chunk_id").isNotNull()
    return raw.where(good).select("r.*"), raw.where(~F.coalesce(good, F.lit(False))).select("line")


def export_results(results: DataFrame, session_id: str, query: str, final_answer: str | None, out: str) -> None:
    """JSON lines, one result each, with the session's fields; written in parallel."""
    rows = results.select(F.to_json(F.struct(F.lit(session_id).alias("session_id"), F.lit(query).alias("query"), F.lit(final_answer).alias("final_answer"), F.struct("*").alias("result"))).alias("value"))
    rows.write.text(out)


def export_document(results: DataFrame, notes: DataFrame, session_id: str, query: str, final_answer: str | None, most: int = 10_000) -> DataFrame:
    """One row: a JSON document of the session, its results and notes. Sessions with more than ``most`` of either are refused; ``export_results`` takes them."""
    for rows, what in ((results, "results"), (notes, "notes")):
        if rows.limit(most + 1).count() > most:
            raise CorpusError("too_many", f"more than {most} {what}; export them as lines", what=session_id)
    noted = F.struct("at", "note")
    rows = results.select(F.struct("*").alias("r")).unionByName(notes.select(noted.alias("n")), allowMissingColumns=True)
    buffers = F.transform(F.sort_array(F.collect_list("n")), lambda n: n["note"])
    both = rows.agg(F.sort_array(F.collect_list("r")).alias("results"), buffers.alias("buffers"))
    document = F.struct(F.lit(session_id).alias("session_id"), F.lit(query).alias("query"), "results", "buffers", F.lit(final_answer).alias("final_answer"))
    return both.select(F.to_json(document).alias("value"))


def emit(events: DataFrame, folder: str) -> None:
    """Append events (ts, event, chunk_id, batch, data) to the progress log, a folder of JSON lines."""
    events.write.mode("append").json(folder)


def rotate(spark: SparkSession, folder: str, most_bytes: int = model.PROGRESS_BYTES) -> bool:
    """Put a progress log of over ``most_bytes`` aside as ``folder.1``, in place of the one put aside before; whether it was."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path) or fs.getContentSummary(path).getLength() <= most_bytes:
        return False
    _, aside = file_system(spark, f"{folder}.1")
    fs.delete(aside, True)
    return fs.rename(path, aside)
