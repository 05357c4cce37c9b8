"""The registered queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import errors, model
from corpusloom.functions import tables
from corpusloom.functions import text as fn
from corpusloom.operators import analyse, chunking, incremental, sessions
from corpusloom.plans import reduce
from corpusloom.plans.running import running_sum
from corpusloom.plans.staging import dealt, new_path, stage
from corpusloom.sources import files as src
from corpusloom.sources import tree as tree_source
from corpusloom.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_ENDINGS = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(src.ENDINGS))
FILES = f"""files AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || ext AS path, ext, source, text, CAST(length(text) AS BIGINT) AS n_chars
  FROM (SELECT *, CASE doc_id % {len(src.ENDINGS)} {_ENDINGS} END AS ext FROM documents))"""
_SIZES = " ".join(f"WHEN ext = '{e}' THEN {n}" for e, n in model.CHUNK_SIZES.items())
SIZE = f"CASE {_SIZES} ELSE {model.DEFAULT_CHUNK_SIZE} END"
#: DuckDB's lines of files, and whole lines dealt to chunks as they fit, one line after the other.
LINES = "l AS MATERIALIZED (SELECT path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files)"
PACKED = """g AS (SELECT path, line, n AS used, 0 AS no FROM n WHERE line = 1 UNION ALL
  SELECT n.path, n.line, CASE WHEN used + n > {0} THEN n ELSE used + n END, CASE WHEN used + n > {0} THEN no + 1 ELSE no END FROM g JOIN n ON n.path = g.path AND n.line = g.line + 1)"""
SHA = "substr(sha256({0}), 1, 16)"
WORDS = "list_filter(regexp_split_to_array(lower({0}), '[ \\t\\n\\r]+'), lambda w: w <> '')"
MAY_COVER = "CAST({0} AS BIGINT)"
_FINDINGS = " UNION ALL ".join(
    f"SELECT doc_id, path, '{r.name}' AS rule, '{r.point}' AS point, unnest(regexp_extract_all(text, '{r.pattern}')) AS evidence, '{r.confidence}' AS confidence FROM files" for r in analyse.RULES
)
FINDINGS = f"{FILES}, findings AS ({_FINDINGS})"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.documents_as_files(table(spark, sf_dir, "documents"))


@query(f"WITH {FINDINGS} SELECT rule, confidence, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT evidence) AS BIGINT) AS n_distinct, CAST(count(DISTINCT path) AS BIGINT) AS n_files FROM findings GROUP BY rule, confidence")
def minimum_slice(spark, sf_dir):
    """Files, rule pack, exact duplicates, counts by rule and confidence."""
    found = analyse.findings(dealt(files(spark, sf_dir)))
    return found.groupBy("rule", "confidence").agg(F.count("*").alias("n"), F.countDistinct("evidence").alias("n_distinct"), F.countDistinct("path").alias("n_files"))


@query(f"WITH {FILES} SELECT path, ext, n_chars FROM files")
def files_metadata(spark, sf_dir):
    return files(spark, sf_dir).select("path", "ext", "n_chars")


@query(f"WITH {FILES} SELECT CAST(sum(n_chars) AS BIGINT) AS total_size, CAST(count(*) AS BIGINT) AS file_count, CAST(count(DISTINCT ext) AS BIGINT) AS n_types FROM files")
def context_metadata(spark, sf_dir):
    return src.context_metadata(files(spark, sf_dir))


@query(f"WITH {FILES} SELECT ext, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST({SIZE} AS INTEGER) AS chunk_size FROM files GROUP BY ext")
def size_lookup(spark, sf_dir):
    rows = files(spark, sf_dir).groupBy("ext").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return rows.withColumn("chunk_size", fn.chunk_size(F.col("ext")))


_CODE = ", ".join(f"'{e}'" for e in model.CODE_EXTENSIONS)
_CONFIG = ", ".join(f"'{e}'" for e in model.CONFIG_EXTENSIONS)
_TYPE = f"CASE WHEN ext IN ({_CODE}) THEN 'code' WHEN ext IN ({_CONFIG}) THEN 'config' WHEN ext IN ('.md', '.rst', '.txt', '.html') THEN 'docs' ELSE 'other' END || ':' || ext"
_LANG = "CASE ext WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' END"


@query(f"WITH {FILES} SELECT path, {_TYPE} AS content_type, {_LANG} AS language FROM files")
def detect_content_type(spark, sf_dir):
    return files(spark, sf_dir).select("path", fn.content_type(fn.extension(F.col("path"))).alias("content_type"), fn.language(F.col("ext")).alias("language"))


@query(f"WITH {FILES} SELECT {_TYPE} AS content_type, CAST(count(*) AS BIGINT) AS n FROM files GROUP BY 1 ORDER BY n DESC, content_type LIMIT 1")
def content_type_majority(spark, sf_dir):
    counts = files(spark, sf_dir).groupBy(fn.content_type(F.col("ext")).alias("content_type")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "content_type").limit(1)


@query(f"WITH {FILES} SELECT path FROM files WHERE NOT (source IN ('src1', 'src3') OR ends_with(path, '.json') OR ends_with(path, '.xml'))")
def prune(spark, sf_dir):
    dirs, globs = src.parse_ignore(["# made elsewhere", "src1/", "src3", "*.json", "*.xml", ""])
    return src.prune(files(spark, sf_dir), dirs, globs).select("path")


@query(f"WITH {FILES} SELECT path, n_chars FROM files WHERE starts_with(path, 'src0/') OR starts_with(path, 'src2/en/')")
def scan_targeted(spark, sf_dir):
    return src.scan_targeted(files(spark, sf_dir), ["src0", "src2/en", "src0/de"]).select("path", "n_chars")


@query(f"""WITH {FILES}, up AS (SELECT path AS file, n_chars, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS path FROM files, unnest([1, 2, 3]) AS u(i))
  SELECT path, CAST(sum(n_chars) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS files, bool_or(path <> file) AS is_dir, CAST(len(string_split(path, '/')) AS BIGINT) AS depth FROM up
  WHERE len(string_split(path, '/')) <= 2 GROUP BY path""")
def tree_explore(spark, sf_dir):
    return src.tree(files(spark, sf_dir), depth=2).select("path", "size", "files", "is_dir", "depth")


@query(f"WITH {FILES} SELECT CAST(count(*) AS BIGINT) AS n_files, CAST(sum(n_chars) AS BIGINT) AS total_size, CAST(max(len(string_split(path, '/'))) AS INTEGER) AS depth FROM files")
def tree_summary(spark, sf_dir):
    return files(spark, sf_dir).agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("total_size"), F.max(F.size(F.split("path", "/"))).alias("depth"))


@query(f"""WITH {FILES} SELECT path, size, CAST(sum(size) OVER (ORDER BY split_part(path, '/', 1) || '/', path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS start
  FROM (SELECT path, CAST(length('=== FILE: ' || path || ' ===' || chr(10) || text || chr(10)) AS BIGINT) AS size FROM files)""")
def concat_with_headers(spark, sf_dir):
    return src.entry_offsets(files(spark, sf_dir))


@query(f"WITH {FILES} SELECT path, substr(text, 1, 100) AS head, right(text, 50) AS tail, substr(text, 11, 20) AS middle FROM files")
def peek(spark, sf_dir):
    t = F.col("text")
    return files(spark, sf_dir).select("path", fn.peek_head(t, 100).alias("head"), fn.peek_tail(t, 50).alias("tail"), fn.peek(t, 10, 30).alias("middle"))


@query(f"WITH {FILES} SELECT path, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '... [truncated]' ELSE text END AS out FROM files")
def truncate_output(spark, sf_dir):
    return files(spark, sf_dir).select("path", fn.truncate_output(F.col("text"), 200).alias("out"))


@query(f"WITH {FILES} SELECT CAST(sum(n_chars) AS BIGINT) AS context_length, CAST(sum(CAST(ceil(n_chars / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM files")
def context_length(spark, sf_dir):
    return files(spark, sf_dir).agg(F.sum("n_chars").alias("context_length"), F.sum(fn.count_tokens(F.col("text"))).alias("tokens"))


@query(f"WITH {FILES} SELECT path, CAST(len(m) AS INTEGER) AS n, array_to_string(list_slice(m, 1, 20), '|') AS matches FROM (SELECT path, regexp_extract_all(text, '[0-9]{{2,}}') AS m FROM files) WHERE len(m) > 0")
def grep(spark, sf_dir):
    pattern = "[0-9]{2,}"
    rows = files(spark, sf_dir).select("path", F.regexp_count("text", F.lit(pattern)).alias("n"), F.array_join(fn.grep(F.col("text"), pattern), "|").alias("matches"))
    return rows.where("n > 0")


_SPANS = f"""{FILES}, m AS (SELECT path, text, regexp_extract_all(text, '[0-9]{{2,}}') AS m, regexp_split_to_array(text, '[0-9]{{2,}}') AS p FROM files),
  i AS (SELECT *, unnest(range(1, least(len(m), 20) + 1)) AS i FROM m),
  s AS (SELECT path, text, m[i] AS match, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM i)"""


@query(f"""WITH {_SPANS} SELECT path, match, start, CAST(start + length(match) AS INTEGER) AS "end",
  substr(text, greatest(start - 100, 0) + 1, start + length(match) + 100 - greatest(start - 100, 0)) AS snippet FROM s""")
def grep_spans(spark, sf_dir):
    """Offsets and snippets of matches."""
    rows = files(spark, sf_dir).where(F.col("text").rlike("[0-9]{2,}"))
    return rows.select("path", F.explode(fn.grep_spans(F.col("text"), "[0-9]{2,}")).alias("m")).select("path", "m.*")


@query(f'WITH {_SPANS} SELECT path, match, start, CAST(start + length(match) AS INTEGER) AS "end" FROM s')
def sql_grep(spark, sf_dir):
    """The same as a table function in SQL."""
    tables.register(spark, corpus_files=dealt(files(spark, sf_dir)))
    return spark.sql("SELECT path, match, start, end FROM corpus_files, LATERAL grep_text(text, '[0-9]{2,}')")


@query(f"""WITH {FILES}, f AS (SELECT * FROM files WHERE path = (SELECT max(path) FROM files WHERE regexp_matches(text, 'token = "[0-9a-f]+"')))
  SELECT path, unnest(regexp_extract_all(text, 'token = "[0-9a-f]+"')) AS match FROM f""")
def grep_file(spark, sf_dir):
    """Matches in one file, the last that has any."""
    rows, pattern = files(spark, sf_dir), 'token = "[0-9a-f]+"'
    path = rows.where(F.col("text").rlike(pattern)).agg(F.max("path")).first()[0] or "none"
    return src.load_file(rows, path).select("path", F.explode(fn.grep(F.col("text"), pattern)).alias("match"))


@query(f"""WITH {FILES} SELECT path, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines,
  CAST(length(substr(text, 1, 500)) - length(replace(substr(text, 1, 500), chr(10), '')) + 1 AS BIGINT) AS line_at_500, replace(lower(path), '_', '-') AS normal FROM files""")
def line_number(spark, sf_dir):
    t = F.col("text")
    normal = F.replace(fn.normalize_path(F.col("path")), F.lit("_"), F.lit("-"))
    return files(spark, sf_dir).select("path", fn.line_number(t, F.length(t)).alias("lines"), fn.line_number(t, F.lit(500)).alias("line_at_500"), normal.alias("normal"))


@query(f"""WITH {FILES} SELECT path, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f', n_chars / 1024.0) || ' KB' ELSE 'large' END AS shown FROM files""")
def format_size(spark, sf_dir):
    return files(spark, sf_dir).select("path", fn.format_size(F.col("n_chars")).alias("shown"))


def _fixed_sql(size: int, overlap: int) -> str:
    return f"""WITH {FILES}, cut AS (SELECT path, text, n_chars, unnest(range(0, greatest(n_chars - {overlap}, 1), {size - overlap})) AS start FROM files WHERE n_chars > 0)
      SELECT path, CAST(start // {size - overlap} AS BIGINT) AS no, CAST(start AS BIGINT) AS start, CAST(least(start + {size}, n_chars) AS BIGINT) AS "end",
        {SHA.format(f"path || '|' || start || '|' || substr(text, start + 1, {size})")} AS chunk_id FROM cut"""


@query(_fixed_sql(1000, 0))
def chunk_fixed(spark, sf_dir):
    return chunking.chunk_fixed(files(spark, sf_dir), 1000, 0, strict=False).select("path", "no", "start", "end", "chunk_id")


@query(_fixed_sql(800, 100))
def chunk_overlap(spark, sf_dir):
    return chunking.chunk_fixed(files(spark, sf_dir), 800, 100, strict=False).select("path", "no", "start", "end", "chunk_id")


@query(f"""WITH {FILES}, cut AS (SELECT path, n_chars, size, unnest(range(0, n_chars, size)) AS start FROM (SELECT *, CAST(floor({SIZE} / 100) AS BIGINT) AS size FROM files))
  SELECT path, CAST(start // size AS BIGINT) AS no, CAST(start AS BIGINT) AS start, CAST(least(start + size, n_chars) AS BIGINT) AS "end" FROM cut""")
def chunk_adaptive(spark, sf_dir):
    return chunking.chunk_adaptive(files(spark, sf_dir), 100).select("path", "no", "start", "end")


@query(f"""WITH {FILES}, c AS (SELECT count(*) AS n FROM (SELECT unnest(range(0, n_chars, 1000)) FROM files))
  SELECT CAST(n AS BIGINT) AS n_chunks, CASE WHEN n > 500 THEN 'refuse' WHEN n > 100 THEN 'warn' ELSE 'ok' END AS state FROM c""")
def chunk_limit(spark, sf_dir):
    return chunking.chunk_limit(chunking.chunk_fixed(files(spark, sf_dir), 1000, 0, strict=False))


@query(f"""WITH RECURSIVE {FILES}, {LINES}, n AS MATERIALIZED (SELECT path, line, length(t) + 1 AS n FROM l), {PACKED.format(500)}
  SELECT g.path, CAST(no AS BIGINT) AS no, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(n) AS BIGINT) AS n_chars FROM g JOIN n USING (path, line) GROUP BY 1, 2""")
def chunk_lines(spark, sf_dir):
    return chunking.chunk_lines(dealt(files(spark, sf_dir)), 500)


@query(f"""WITH RECURSIVE {FILES}, {LINES}, z AS (SELECT path, max(line) AS last FROM l GROUP BY path),
  n AS MATERIALIZED (SELECT path, line, length(t) + CAST(line < last AS INTEGER) AS n FROM l JOIN z USING (path) WHERE line < last OR t <> ''), {PACKED.format(2000)}
  SELECT path, CAST(no AS BIGINT) AS no, CAST(min(line) AS BIGINT) AS start_line, CAST(max(line) AS BIGINT) AS end_line, true AS is_fallback FROM g GROUP BY 1, 2""")
def chunk_scopes_prose(spark, sf_dir):
    """Texts without a scope: all chunks are cut between lines."""
    return chunking.chunk_scopes(dealt(files(spark, sf_dir)), 2000).drop("content")


# Code written from parts, 40 to a file: how a file begins, a part's method (K: its key, N: its name), how it ends, and what the scopes are called.
_CODE = (
    (".py", "class Parts:\n", "    def part_K(self):\n        # class Fake: N\n        return 'def fake(): N'\n", "", "class", "method"),
    (".js", "export class Parts {\n", "  part_K(a) {\n    // class Fake { N\n    return `function fake() { ${a} N`; }\n", "}\n", "class", "method"),
    (".ts", "abstract class Parts<T> extends Base {\n", "  public part_K<T>(a: T): string {\n    /* class Fake { N */\n    return 'class Fake { N'; }\n", "}\n", "class", "method"),
    (".java", "public final class Parts {\n", "  public String part_K(int a) {\n    // void fake() { N\n    return \"class Fake { N\"; }\n", "}\n", "class", "method"),
    (".go", "package parts\n", "func part_K(a int) string {\n\t// func fake() { N\n\treturn \"func fake() { N\" }\n", "", None, "function"),
)
_PER_FILE, _CODE_CHUNK = 40, 1500


def _of_kind(values, like: str = "f % 5") -> str:
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for v in values]
    return f"CASE {like} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(quoted)) + " END"


_CODE_UNITS = f"""p AS (SELECT p_partkey // {_PER_FILE} AS f, p_partkey AS k, p_name AS n, row_number() OVER (PARTITION BY p_partkey // {_PER_FILE} ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_partkey // {_PER_FILE}) AS m FROM part),
  u AS (SELECT DISTINCT f, 0 AS i, {_of_kind(c[1] for c in _CODE)} AS t FROM p
    UNION ALL SELECT f, i, replace(replace({_of_kind(c[2] for c in _CODE)}, 'K', k::VARCHAR), 'N', n) || CASE WHEN i = m THEN {_of_kind(c[3] for c in _CODE)} ELSE '' END FROM p),
  x AS (SELECT DISTINCT f, 'code/' || f || {_of_kind(c[0] for c in _CODE)} AS path FROM p)"""


def _code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of code in five languages, a class with a method for each of ``_PER_FILE`` parts; strings and comments look like code."""
    at = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in _CODE]), (F.col("f") % len(_CODE) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / _PER_FILE).alias("f"), "p_partkey", "p_name")
    method = F.replace(F.replace(at(2), F.lit("K"), F.col("p_partkey").cast("string")), F.lit("N"), F.col("p_name"))
    whole = rows.withColumn("t", method).groupBy("f").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "t"))).alias("parts"))
    text = F.concat(at(1), F.array_join(F.transform("parts", lambda p: p["t"]), ""), at(3))
    return whole.select(F.concat(F.lit("code/"), F.col("f").cast("string"), at(0)).alias("path"), at(0).alias("ext"), text.alias("text"))


@query(f"""WITH {_CODE_UNITS} SELECT path, CAST(3 * i - 1 AS BIGINT) AS line, CAST(3 * i + 1 AS BIGINT) AS last_line, CAST(f % 5 <> 4 AS BIGINT) AS depth, {_of_kind(c[5] for c in _CODE)} AS kind, 'part_' || k AS name FROM p JOIN x USING (f)
  UNION ALL SELECT DISTINCT path, CAST(1 AS BIGINT), CAST(3 * m + 1 + CAST(f % 5 > 0 AS INTEGER) AS BIGINT), CAST(0 AS BIGINT), 'class', 'Parts' FROM p JOIN x USING (f) WHERE f % 5 <> 4""")
def extract_scopes(spark, sf_dir):
    """Scopes of code written from parts, whose strings and comments look like scopes."""
    return chunking.extract_scopes(dealt(_code_files(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_CODE_UNITS}, g AS (SELECT f, i, length(t) AS used, 0 AS no FROM u WHERE i = 0 UNION ALL
    SELECT n.f, n.i, CASE WHEN cut THEN length(n.t) ELSE used + length(n.t) END, no + CAST(cut AS INTEGER) FROM (SELECT u.f, u.i, u.t, g.used, g.no, g.used + length(u.t) > {_CODE_CHUNK} OR u.f % 5 = 4 AND g.used >= {_CODE_CHUNK // 2} AS cut FROM g JOIN u ON u.f = g.f AND u.i = g.i + 1) n)
  SELECT path, CAST(no AS BIGINT) AS no, CAST(min(CASE i WHEN 0 THEN 1 ELSE 3 * i - 1 END) AS BIGINT) AS start_line, CAST(max(CASE i WHEN 0 THEN 1 ELSE 3 * i + 1 + CAST(i = m AND f % 5 IN (1, 2, 3) AS INTEGER) END) AS BIGINT) AS end_line, false AS is_fallback
  FROM g JOIN x USING (f) JOIN (SELECT DISTINCT f, m FROM p) USING (f) GROUP BY 1, 2""")
def chunk_scopes(spark, sf_dir):
    """The same code in chunks that end where scopes begin: whole methods, as many as fit."""
    return chunking.chunk_scopes(dealt(_code_files(spark, sf_dir)), _CODE_CHUNK).drop("content")


@query(f"""WITH {FILES}, f AS (SELECT path, unnest(range(0, n_chars, 700)) AS start, n_chars FROM files), q AS (SELECT path, start, least(start + 150, n_chars) AS "end" FROM f),
  c AS (SELECT path, n_chars, unnest(range(0, greatest(n_chars - 100, 1), 700)) AS low FROM files WHERE n_chars > 0)
  SELECT q.path, CAST(q.start AS BIGINT) AS start, CAST(c.low // 700 AS BIGINT) AS no FROM q JOIN c ON q.path = c.path AND q.start < least(c.low + 800, c.n_chars) AND c.low < q."end" """)
def findings_in_chunks(spark, sf_dir):
    """Spans of 150 characters with the overlapping chunks that they touch."""
    rows = files(spark, sf_dir)
    n = F.col("n_chars")
    starts = F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(700).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    found = rows.select("path", "n_chars", starts.alias("start")).select("path", "start", F.least(F.col("start") + 150, n).alias("end"))
    return chunking.overlapping(found, chunking.chunk_fixed(rows, 800, 100, strict=False), 800).select("path", "start", "no")


@query(f"WITH {FILES} SELECT path, sha256(text) AS hash FROM files")
def file_hash(spark, sf_dir):
    return incremental.manifest(files(spark, sf_dir)).select(F.col("file_path").alias("path"), "hash")


_MANIFESTS = f"""{FILES}, m0 AS (SELECT path, sha256(text) AS h FROM files WHERE doc_id % 10 <> 0),
  m1 AS (SELECT path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM files WHERE doc_id % 10 <> 1),
  delta AS (SELECT coalesce(m0.path, m1.path) AS file_path, CASE WHEN m0.path IS NULL THEN 'added' WHEN m1.path IS NULL THEN 'deleted' WHEN m0.h <> m1.h THEN 'changed' END AS change
    FROM m0 FULL OUTER JOIN m1 ON m0.path = m1.path)"""


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two states of the tree: files come, go and change by id."""
    now = files(spark, sf_dir)
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return now.where("doc_id % 10 <> 0"), now.where("doc_id % 10 <> 1").withColumn("text", changed)


@query(f"WITH {_MANIFESTS} SELECT file_path, change FROM delta WHERE change IS NOT NULL")
def manifest_diff(spark, sf_dir):
    a, b = _versions(spark, sf_dir)
    return incremental.diff(incremental.manifest(a), incremental.manifest(b))


@query(f"WITH {_MANIFESTS} SELECT change, CAST(count(*) AS BIGINT) AS n FROM delta WHERE change IS NOT NULL GROUP BY change")
def delta_counts(spark, sf_dir):
    return manifest_diff(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"))


@query(f"""WITH {_MANIFESTS}, c AS (SELECT path, n_chars, text, unnest(range(0, n_chars, 1000)) AS start FROM files WHERE doc_id % 10 <> 0)
  SELECT DISTINCT {SHA.format("path || '|' || start || '|' || substr(text, start + 1, 1000)")} AS chunk_id FROM c WHERE path IN (SELECT file_path FROM delta WHERE change IN ('changed', 'deleted'))""")
def affected_chunks(spark, sf_dir):
    before, _ = _versions(spark, sf_dir)
    return incremental.affected_chunks(chunking.chunk_fixed(before, 1000, 0, strict=False), manifest_diff(spark, sf_dir))


@query(f"WITH {_MANIFESTS}, {FINDINGS.removeprefix(FILES + ', ')} SELECT path, rule, evidence FROM findings WHERE path NOT IN (SELECT file_path FROM delta WHERE change = 'deleted')")
def ghost_cleanup(spark, sf_dir):
    found = analyse.findings(dealt(files(spark, sf_dir))).withColumn("file", F.col("path"))
    return reduce.without_deleted(found, manifest_diff(spark, sf_dir).where("change = 'deleted'")).select("path", "rule", "evidence")


@query(f"WITH {FINDINGS} SELECT path, rule, point, evidence, confidence FROM findings")
def rule_map(spark, sf_dir):
    return analyse.findings(dealt(files(spark, sf_dir)))


@query(f"WITH {FINDINGS} SELECT confidence, CAST(count(*) AS BIGINT) AS n, CAST(max(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS INTEGER) AS score FROM findings GROUP BY confidence")
def findings_by_confidence(spark, sf_dir):
    return analyse.findings(dealt(files(spark, sf_dir))).groupBy("confidence").agg(F.count("*").alias("n"), F.max(fn.confidence_score(F.col("confidence"))).alias("score"))


@query(f"WITH {FINDINGS} SELECT rule, evidence, CAST(min(doc_id) AS BIGINT) AS doc_id, CAST(count(*) AS BIGINT) AS n FROM findings GROUP BY rule, evidence")
def exact_dedup(spark, sf_dir):
    found = analyse.findings(dealt(files(spark, sf_dir)), by="doc_id")
    return reduce.exact_groups(found, ["rule", "evidence"], "doc_id")


@query(f"WITH {FINDINGS}, u AS (SELECT count(*) AS n, count(DISTINCT rule || '|' || evidence) AS d FROM findings) SELECT CAST(n AS BIGINT) AS total, CAST(d AS BIGINT) AS \"unique\", round(1 - d / n, 6) AS ratio FROM u")
def dedup_ratio(spark, sf_dir):
    rows = analyse.findings(dealt(files(spark, sf_dir))).agg(F.count("*").alias("total"), F.countDistinct(F.concat_ws("|", "rule", "evidence")).alias("unique"))
    return rows.withColumn("ratio", F.round(reduce.dedup_ratio(F.col("total"), F.col("unique")), 6))


@query(f"""WITH {FINDINGS} SELECT path, rule, evidence, CAST(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS INTEGER) AS score FROM (SELECT DISTINCT path, rule, evidence, confidence FROM findings)
  ORDER BY score DESC, rule, path, evidence LIMIT 10""")
def top_findings(spark, sf_dir):
    rows = analyse.findings(dealt(files(spark, sf_dir))).select("path", "rule", "evidence", fn.confidence_score(F.col("confidence")).alias("score")).distinct()
    return rows.orderBy(F.desc("score"), "rule", "path", "evidence").limit(10)


@query(f"WITH t AS (SELECT doc_id, list_distinct({WORDS.format('text')}) AS w FROM documents) SELECT doc_id, CAST(len(list_intersect(w, ['the', 'and', 'of'])) AS BIGINT) AS relevance FROM t")
def relevance_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.relevance(F.col("text"), "the and OF").alias("relevance"))


_BLOCKS = f"""t AS (SELECT doc_id, length(text) AS len, list_distinct({WORDS.format('text')}) AS w,
  list_distinct(list_slice(list_filter({WORDS.format('text')}, lambda w: length(w) >= 3), 1, 5)) AS b FROM documents)"""


@query(f"WITH {_BLOCKS} SELECT token, CAST(count(*) AS BIGINT) AS n, CAST(min(doc_id) AS BIGINT) AS first_id FROM (SELECT doc_id, unnest(b) AS token FROM t) GROUP BY token")
def token_index(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(fn.block_tokens(F.col("text"))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


_CLASSES = f"""{_BLOCKS}, k AS (SELECT *, sha256(array_to_string(list_sort(w), ' ') || ' | ' || array_to_string(list_sort(b), ' ') || ' ' || len) AS key FROM t),
  c AS (SELECT key, min(doc_id) AS id, any_value(w) AS w, any_value(b) AS b, any_value(len) AS len FROM k GROUP BY key),
  cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM (SELECT id, unnest(b) AS token FROM c) x JOIN (SELECT id, unnest(b) AS token FROM c) y ON x.token = y.token AND x.id < y.id),
  p AS (SELECT a, b, s FROM (SELECT cand.a, cand.b, len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) AS s
    FROM cand JOIN c x ON cand.a = x.id JOIN c y ON cand.b = y.id WHERE least(x.len, y.len) >= 0.5 * greatest(x.len, y.len)) WHERE s >= 0.7)"""


@query(f"WITH {_CLASSES} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(s, 6) AS similarity FROM p")
def near_dup_jaccard(spark, sf_dir):
    """Similar classes of documents: pairs between representatives."""
    classes, _ = reduce.token_classes(dealt(table(spark, sf_dir, "documents")), "doc_id", "text")
    return reduce.similar_classes(classes, 0.7).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH RECURSIVE {_CLASSES}, e AS (SELECT a AS u, b AS v FROM p UNION ALL SELECT b, a FROM p),
  r AS (SELECT id, id AS root FROM c UNION SELECT e.v, r.root FROM r JOIN e ON r.id = e.u)
  SELECT k.doc_id, CAST(c.id AS BIGINT) AS class_id, CAST(g.root AS BIGINT) AS group_id, CAST((SELECT count(*) FROM e WHERE e.u = c.id) AS BIGINT) AS n_links
  FROM k JOIN c ON k.key = c.key JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) g ON g.id = c.id""")
def near_dup_groups(spark, sf_dir):
    return reduce.near_groups(dealt(table(spark, sf_dir, "documents")), "doc_id", "text")


_STATEMENTS = """s AS (SELECT doc_id * 2 AS finding_id, 'document ' || doc_id || ' is ' || CASE WHEN toxic = 1 THEN '' ELSE 'not ' END || 'toxic' AS point FROM labels
  UNION ALL SELECT doc_id * 2 + 1, 'document ' || doc_id || ' is ' || CASE WHEN quality = 1 THEN '' ELSE 'not ' END || 'toxic' FROM labels)"""
_NEG = "(contains({0}, 'no ') OR contains({0}, 'not ') OR contains({0}, 'never ') OR contains({0}, 'without ') OR contains({0}, 'n''t '))"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two statements about every labelled document; they contradict where the labels differ."""
    rows = table(spark, sf_dir, "labels")
    say = lambda yes: F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(" is "), F.when(yes, "").otherwise("not "), F.lit("toxic"))
    one = rows.select((F.col("doc_id") * 2).alias("finding_id"), say(F.col("toxic") == 1).alias("point"))
    return one.unionByName(rows.select((F.col("doc_id") * 2 + 1).alias("finding_id"), say(F.col("quality") == 1).alias("point")))


def _opposed_sql(said: str, least: float) -> str:
    """Classes of equal words, asserting or denying, and the pairs of them that are alike."""
    return f"""WITH {said}, w AS (SELECT finding_id, {_NEG.format('lower(point)')} AS neg, list_sort(list_distinct({WORDS.format('point')})) AS w FROM s),
      t AS (SELECT min(finding_id) AS id, neg, w, count(*) AS n FROM w GROUP BY neg, w),
      p AS (SELECT a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS s FROM t a JOIN t b ON NOT a.neg AND b.neg)
      SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(s, 6) AS similarity, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b FROM p WHERE s >= {least}"""


@query(_opposed_sql(_STATEMENTS, 0.8))
def contradictions(spark, sf_dir):
    """Pairs of classes of statements about labelled documents that are alike and opposed."""
    return reduce.contradictions(statements(spark, sf_dir), 0.8, digits=6)


@query(_opposed_sql("s AS (SELECT event_id AS finding_id, CASE WHEN value < 50 THEN 'not ' ELSE '' END || event_type || ' u' || user_id || ' h' || hour(ts) || ' d' || day(ts) AS point FROM events)", 0.4))
def contradictions_broad(spark, sf_dir):
    """The same at the default similarity, over what events say about user, hour and day."""
    said = F.concat(F.when(F.col("value") < 50, "not ").otherwise(""), "event_type", F.lit(" u"), F.col("user_id").cast("string"), F.lit(" h"), F.hour("ts").cast("string"), F.lit(" d"), F.day("ts").cast("string"))
    return reduce.contradictions(table(spark, sf_dir, "events").select(F.col("event_id").alias("finding_id"), said.alias("point")), digits=6)


@query(f"WITH {_STATEMENTS} SELECT CAST(finding_id AS BIGINT) AS finding_id, {_NEG.format('lower(point)')} AS negated FROM s")
def negation_flag(spark, sf_dir):
    return statements(spark, sf_dir).select("finding_id", fn.negation(F.col("point")).alias("negated"))


_LEAD = """CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"""


@query(f"""WITH {FINDINGS}, f AS (SELECT *, rule || '|' || evidence AS g FROM findings)
  SELECT g AS group_id, CAST(min(doc_id) AS BIGINT) AS doc_id, any_value(confidence) AS confidence, CAST(count(*) AS BIGINT) AS n_findings, CAST(count(DISTINCT path) AS BIGINT) AS n_files FROM f GROUP BY g""")
def merge_group(spark, sf_dir):
    """Findings of one rule and evidence merged by the library's ``merged``; every file counts."""
    rows = files(spark, sf_dir).select("doc_id", "path", "text")
    found = analyse.findings(rows.withColumn("key", F.struct("doc_id", "path")), by="key").select("key.doc_id", F.col("key.path").alias("file"), F.concat_ws("|", "rule", "evidence").alias("group_id"), "confidence")
    # A finding's id says its document and its group, so that a document may be in several groups.
    found = stage(found.withColumn("id", F.struct("doc_id", "group_id")), "findings")
    groups = found.select("id", "group_id").distinct()
    return reduce.merged(found.drop("group_id", "doc_id"), groups, "id").select("group_id", "id.doc_id", "confidence", "n_findings", "n_files")


_ATTEMPTS = "a AS (SELECT event_id, user_id AS chunk_id, ts AS processed_at, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'placeholder' ELSE 'success' END AS status, value FROM events)"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of attempts on chunks."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "placeholder").otherwise("success")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("chunk_id"), F.col("ts").alias("processed_at"), kind.alias("status"), "value")


@query(f"WITH {_ATTEMPTS} SELECT chunk_id, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY processed_at DESC, event_id DESC) AS rn FROM a) WHERE rn = 1")
def idempotent_result(spark, sf_dir):
    return sessions.latest(attempts(spark, sf_dir), order=("processed_at", "event_id")).select("chunk_id", "event_id", "status")


@query(f"WITH {_ATTEMPTS} SELECT DISTINCT o_custkey AS chunk_id FROM orders WHERE o_custkey NOT IN (SELECT chunk_id FROM a WHERE status <> 'placeholder')")
def pending_chunks(spark, sf_dir):
    chunks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chunk_id")).distinct()
    return sessions.pending(chunks, attempts(spark, sf_dir))


@query(f"""WITH {_ATTEMPTS}, l AS (SELECT chunk_id, status FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY processed_at DESC, event_id DESC) AS rn FROM a) WHERE rn = 1)
  SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status = 'success') AS BIGINT) AS processed, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed,
  round(100.0 * count(*) FILTER (status = 'success') / count(*), 2) AS percent FROM customer LEFT JOIN l ON c_custkey = chunk_id""")
def session_status(spark, sf_dir):
    chunks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"))
    return sessions.status(chunks, sessions.latest(attempts(spark, sf_dir), order=("processed_at", "event_id")))


@query("""WITH f AS (SELECT event_id + 1 AS no, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'placeholder' ELSE 'success' END AS s FROM events), m AS (SELECT min(no) AS low FROM f)
  SELECT CAST((no - low) // 5 + 1 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (s = 'success') AS BIGINT) AS succeeded, CAST(count(*) FILTER (s = 'placeholder') AS BIGINT) AS placeholders,
    CAST(count(*) FILTER (s = 'failed') AS BIGINT) AS failed, round(count(*) FILTER (s = 'failed') / count(*), 4) AS rate FROM f, m GROUP BY 1""")
def batch_stats(spark, sf_dir):
    return sessions.batches(_numbered(spark, sf_dir))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts(spark, sf_dir)
    low = rows.agg(F.min("event_id")).first()[0] or 0
    return rows.select((F.col("event_id") - low + 1).alias("no"), "status")


@query("""WITH f AS (SELECT event_id, user_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no FROM events),
  b AS (SELECT user_id, (no - 1) // 2 + 1 AS batch, count(*) FILTER (failed) / count(*) AS rate FROM f GROUP BY 1, 2)
  SELECT user_id, CAST(batch AS BIGINT) AS batch, coalesce(lag(rate, 1) OVER w > 0.5, false) AND coalesce(lag(rate, 2) OVER w > 0.5, false) AS fall_back FROM b WINDOW w AS (PARTITION BY user_id ORDER BY batch)""")
def failure_rate_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    rows = running_sum(rows, F.lit(1), [F.col("event_id")], "no", ("user_id",))
    rates = rows.groupBy("user_id", (F.floor((F.col("no") - 1) / 2) + 1).alias("batch")).agg((F.count_if("failed") / F.count("*")).alias("rate"))
    return sessions.fall_back(rates, ["user_id"]).select("user_id", "batch", "fall_back")


@query("SELECT event_id AS no FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT (SELECT least(CAST(floor(0.15 * count(*)) AS BIGINT), 500) FROM events)")
def escalation_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return sessions.within_budget(rows.where("event_type = 'error'").select(F.col("event_id").alias("no")), rows.count())


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (event_type IN ('error', 'view') AND event_id % 4 >= 2) AS BIGINT) AS escalated FROM events GROUP BY user_id""")
def should_escalate(spark, sf_dir):
    failure = F.when(F.col("event_type") == "error", "quality_low").when(F.col("event_type") == "view", "complexity").otherwise("timeout")
    yes = sessions.should_escalate(failure, F.col("event_id") % 4)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(yes).alias("escalated"))


@query("""WITH s AS (SELECT o_orderkey AS session_id, CAST(o_totalprice * 1000 AS BIGINT) AS size, o_orderdate AS mtime FROM orders), n AS (SELECT max(mtime) AS now FROM s),
  y AS (SELECT session_id, size, sum(size) OVER (ORDER BY mtime DESC, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM s, n WHERE mtime >= now - INTERVAL 7 DAY)
  SELECT session_id, size, 'age' AS reason FROM s, n WHERE mtime < now - INTERVAL 7 DAY UNION ALL SELECT session_id, size, 'space' FROM y WHERE kept > 1073741824""")
def sessions_gc(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.round(F.col("o_totalprice") * 1000).cast("long").alias("size"), F.col("o_orderdate").alias("mtime"))
    return sessions.to_delete(rows, F.lit(rows.agg(F.max("mtime")).first()[0]))


@query("SELECT o_orderkey AS session_id, o_orderdate AS mtime FROM orders ORDER BY mtime DESC, session_id LIMIT 20")
def list_sessions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("mtime")).orderBy(F.desc("mtime"), "session_id").limit(20)


_SAFE = r"""regexp_replace(regexp_replace({0}, '<!--|-->|\]\]>', '', 'g'), '(?i)<(/?)\s*(system|query|position|content|instructions|response|format)\b[^<>]*>', '[\1\2]', 'g')"""
_MESSAGE = "CASE event_type WHEN 'error' THEN 'connection timed out' WHEN 'view' THEN '' WHEN 'click' THEN 'rate limit' WHEN 'signup' THEN 'invalid json in answer' ELSE 'short' END"


@query(f"""SELECT CASE {_MESSAGE} WHEN 'connection timed out' THEN 'timeout' WHEN '' THEN 'unknown' WHEN 'rate limit' THEN 'rate_limit' WHEN 'short' THEN 'quality_low' ELSE 'parse_error' END AS failure,
  CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def classify_failure(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(fn.failure_type(F.expr(_MESSAGE)).alias("failure"))
    return rows.groupBy("failure").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, 'c' || conv_id AS chunk_id, role AS point, CASE WHEN turn % 2 = 0 THEN 'high' ELSE 'low' END AS confidence FROM conversations WHERE turn % 3 <> 2""")
def parse_response(spark, sf_dir):
    """Answers built from turns, fenced, bare or broken, read back."""
    body = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("chunk_id"), F.array(F.struct(F.col("role").alias("point"), F.when(F.col("turn") % 2 == 0, "high").otherwise("low").alias("confidence"))).alias("findings")))
    answer = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))).when(F.col("turn") % 3 == 1, body).otherwise("no { answer")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", analyse.parse_response(answer).alias("r")).where("r.chunk_id is not null")
    return rows.select("conv_id", "turn", "r.chunk_id", F.explode("r.findings").alias("f")).select("conv_id", "turn", "chunk_id", "f.point", "f.confidence")


_MARKED = "CASE WHEN turn % 4 = 0 THEN 'so FINAL(' || role || ') and NEEDS_MORE(x' || turn || ')' WHEN turn % 4 = 1 THEN 'UNABLE(none)' ELSE text END"


@query("""SELECT conv_id, turn, unnest(CASE WHEN turn % 4 = 0 THEN ['FINAL:' || role, 'NEEDS_MORE:x' || turn] ELSE ['UNABLE:none'] END) AS marker FROM conversations WHERE turn % 4 IN (0, 1)""")
def parse_markers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_MARKED).alias("t")).where(analyse.has_marker(F.col("t")))
    return rows.select("conv_id", "turn", F.explode(analyse.markers(F.col("t"))).alias("m")).select("conv_id", "turn", F.concat_ws(":", "m.marker_type", "m.content").alias("marker"))


@query(f"""SELECT conv_id, turn, concat_ws(chr(10), '<system>{analyse.FOCUS["security"]}</system>', '<query>find [/query]</query>', '<position>' || turn || ' of 9</position>', '<instructions>{analyse.DUTIES}</instructions>',
  '<content>' || {_SAFE.format("text")} || '</content>', '<format>{analyse.FORMAT}</format>') AS prompt FROM conversations""")
def prompt_build(spark, sf_dir):
    made = analyse.prompt(F.col("text"), "find </query>", F.col("turn"), F.lit(9), "security")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("prompt"))


@query(f"""WITH t AS (SELECT page_id, html || '<Content x="1">' || chr(65308) || '/sys' || chr(8203) || 'tem' || chr(65310) AS h FROM pages)
  SELECT page_id, {_SAFE.format("replace(replace(replace(h, chr(8203), ''), chr(65308), '<'), chr(65310), '>')")} AS safe FROM t""")
def sanitize_xml(spark, sf_dir):
    """Pages that end in tags of the prompt, plain and spelled with look-alikes."""
    odd = F.concat("html", F.lit('<Content x="1">\uff1c/sys\u200btem\uff1e'))
    return table(spark, sf_dir, "pages").select("page_id", fn.sanitize_xml(odd).alias("safe"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    return ev.tumbling(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT start, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start")
def sliding_windows(spark, sf_dir):
    return ev.sliding(table(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", CAST(count(*) AS BIGINT) AS n FROM k GROUP BY user_id, s""")
def session_windows(spark, sf_dir):
    return ev.sessions(table(spark, sf_dir, "events"))


@query("SELECT event_type AS event, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def progress_counts(spark, sf_dir):
    """The progress log's counts, over events."""
    return ev.without_repeats(table(spark, sf_dir, "events")).groupBy(F.col("event_type").alias("event")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT CAST(floor(l_extendedprice * 5) AS BIGINT) AS size, CAST(floor(l_quantity * 1500) AS BIGINT) AS overlap FROM lineitem),
  c AS (SELECT CASE WHEN size < 50000 OR size > 300000 THEN 'chunk_size' WHEN overlap > 50000 OR overlap >= size THEN 'overlap' ELSE 'none' END AS code FROM r)
  SELECT code, CAST(CASE code WHEN 'none' THEN 0 ELSE 2 END AS INTEGER) AS exit_code, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY code""")
def error_codes(spark, sf_dir):
    """Requests for chunks, what the library refuses of them, and the exit code of that."""
    rows = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_extendedprice") * 5).alias("size"), F.floor(F.col("l_quantity") * 1500).alias("overlap"))
    code = F.coalesce(chunking.size_fault(F.col("size"), F.col("overlap")), F.lit("none"))
    counts = rows.groupBy(code.alias("code")).agg(F.count("*").alias("n"))
    exits = errors.table(spark).select("code", F.col("exit_code").alias("e"))
    return counts.join(F.broadcast(exits), "code", "left").select("code", F.coalesce("e", F.lit(0)).alias("exit_code"), "n")


@query(f"""WITH RECURSIVE {FILES}, {LINES}, n AS MATERIALIZED (SELECT path, line, length(t) + 1 AS n FROM l), {PACKED.format(500)},
  c AS (SELECT path, no, greatest(min(line) - 5, 1) AS first, max(line) AS high FROM g GROUP BY 1, 2)
  SELECT c.path, CAST(c.no AS BIGINT) AS no, CAST(c.first AS BIGINT) AS start_line, CAST(c.high AS BIGINT) AS end_line, sha256(string_agg(l.t, chr(10) ORDER BY l.line)) AS hash
  FROM c JOIN l ON l.path = c.path AND l.line BETWEEN c.first AND c.high GROUP BY 1, 2, 3, 4""")
def fallback_text_chunk(spark, sf_dir):
    rows = chunking.chunk_lines_overlapping(dealt(files(spark, sf_dir)), 500, 5)
    return rows.select("path", "no", "start_line", "end_line", F.sha2("content", 256).alias("hash"))


@query(f"WITH {FILES} SELECT path, greatest(30.0, least(octet_length(encode(text)) / 1048576 * 2, 120.0)) AS seconds, octet_length(encode(text)) > 4096 AS large FROM files")
def chunking_timeout(spark, sf_dir):
    size = F.octet_length("text")
    return files(spark, sf_dir).select("path", fn.chunking_timeout(size).alias("seconds"), (size > 4096).alias("large"))


@query(f"WITH {FILES} SELECT path, ends_with(path, '.js') OR list_has_any(string_split(path, '/'), ['src1', 'src3', 'de']) AS ignored FROM files")
def should_ignore(spark, sf_dir):
    return files(spark, sf_dir).select("path", src.should_ignore(F.col("path"), ("*.js", "src[13]", "d?")).alias("ignored"))


@query(f"WITH {FILES} SELECT path, n_chars FROM files WHERE path = (SELECT min(path) FROM files WHERE octet_length(encode(text)) <= 10485760)")
def load_file(spark, sf_dir):
    rows = files(spark, sf_dir)
    first = rows.agg(F.min("path")).first()[0] or "none"
    return src.load_file(rows, first).select("path", "n_chars")


@query(f"""WITH {FILES}, c AS (SELECT path, text, unnest(range(0, n_chars, 1000)) AS start FROM files WHERE path = (SELECT max(path) FROM files))
  SELECT CAST(start AS BIGINT) AS start, {SHA.format("path || '|' || start || '|' || substr(text, start + 1, 1000)")} AS chunk_id FROM c""")
def chunks_for_file(spark, sf_dir):
    rows = files(spark, sf_dir)
    path = rows.agg(F.max("path")).first()[0]
    return incremental.chunks_for_file(chunking.chunk_fixed(rows, 1000, 0, strict=False), path).select("start", "chunk_id")


@query(f"WITH {_BLOCKS} SELECT token, CAST(count(*) AS BIGINT) AS n, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS candidates FROM (SELECT doc_id, unnest(b) AS token FROM t) GROUP BY token HAVING count(*) > 1")
def block_candidates(spark, sf_dir):
    """How many pairs each word of the starts would bring together; they are counted, not listed."""
    rows = table(spark, sf_dir, "documents").select(F.explode(fn.block_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return rows.where("n > 1").withColumn("candidates", F.expr("n * (n - 1) div 2"))


@query()
def near_dup_ratio(spark, sf_dir):
    """Turns of conversations, and every fourth again with changed letters, alike by their characters' order; tests compare them with all pairs."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), "text")
    changed = rows.where("id % 4 = 0").select((F.col("id") + 50_000).alias("id"), F.translate(F.regexp_replace("text", "([aeiou])n", "n$1"), "d", "b").alias("text"))
    return reduce.similar_by_ratio(rows.unionByName(changed), "id", "text", 0.7)


@query("""SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS flagged, CAST(sum(length('document ' || doc_id)) AS BIGINT) AS chars FROM labels""")
def verification_counts(spark, sf_dir):
    point = F.concat(F.when(F.col("toxic") == 1, f"{fn.VERIFY}: ").otherwise(""), F.lit("document "), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "labels").select(point.alias("point")).agg(
        F.count("*").alias("n"), F.count_if(fn.needs_verification(F.col("point"))).alias("flagged"), F.sum(F.length(fn.without_flag(F.col("point")))).cast("long").alias("chars")
    )


@query(f"WITH {_MANIFESTS}, {FINDINGS.removeprefix(FILES + ', ')} SELECT path, CAST(count(*) AS BIGINT) AS n FROM findings WHERE path IN (SELECT file_path FROM delta WHERE change = 'deleted') GROUP BY path")
def filtered_deleted_files(spark, sf_dir):
    """Ghost findings by deleted file."""
    found = analyse.findings(dealt(files(spark, sf_dir))).withColumn("file", F.col("path"))
    deleted = manifest_diff(spark, sf_dir).where("change = 'deleted'")
    gone = reduce.ghosts(found.withColumnRenamed("evidence", "quoted"), deleted).distinct()
    rows = found.withColumnRenamed("evidence", "quoted")
    return rows.withColumn("ghost", reduce.row_hash(rows)).join(gone.select("ghost"), "ghost", "left_semi").groupBy("path").agg(F.count("*").alias("n"))


_SAID = f"""{_STATEMENTS}, x AS (SELECT finding_id, point, CASE finding_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, finding_id % 5 = 0 AS verify,
  finding_id % 7 = 0 AS gone FROM s), k AS (SELECT * FROM x WHERE NOT gone)"""


def _said(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Statements as findings in files, of which every seventh is deleted."""
    rows = statements(spark, sf_dir)
    sure = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("finding_id") % 3 + 1).cast("int"))
    point = F.concat(F.when(F.col("finding_id") % 5 == 0, f"{fn.VERIFY} ").otherwise(""), "point")
    found = rows.select("finding_id", point.alias("point"), sure.alias("confidence"), F.concat(F.lit("docs/"), F.col("finding_id").cast("string")).alias("file"))
    return found, found.where("finding_id % 7 = 0").select(F.upper("file").alias("file_path"))


@query(f"""WITH {_SAID}, g AS (SELECT point, count(*) AS n, bool_or(verify) AS verify, arg_min(finding_id, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END * 10000000000 + finding_id) AS lead FROM k GROUP BY point),
  t AS (SELECT lead, {_NEG.format('point')} AS neg, list_distinct({WORDS.format('point')}) AS w FROM g),
  o AS (SELECT count(*) AS n FROM t a JOIN t b ON NOT a.neg AND b.neg WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.8)
  SELECT CAST(sum(g.n) AS BIGINT) AS total_findings, CAST(count(*) AS BIGINT) AS unique_findings, CAST(count(*) FILTER (verify) AS BIGINT) AS verification_required, round(1 - count(*) / sum(g.n), 6) AS deduplication_ratio,
    CAST((SELECT count(*) FROM x WHERE gone) AS BIGINT) AS filtered_deleted, CAST((SELECT n FROM o) AS BIGINT) AS contradictions FROM g""")
def aggregate_findings(spark, sf_dir):
    """The whole reduce over statements about labelled documents, as its row of counts."""
    found, deleted = _said(spark, sf_dir)
    return reduce.aggregate_findings(found, "toxic document", deleted, 0.9, 0.8).counts


_BALANCE = """'customers in nation ' || n_name || 'a ' || n_name || 'b ' || n_name || 'c ' || n_name || 'd balance segment ' || c_mktsegment || CASE WHEN c_acctbal >= 0 THEN ' stays well above zero' ELSE ' does not drop below nothing' END"""


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements about customers: alike within a nation and sign, opposed between the signs of a nation, apart between nations."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    of = [F.concat("n_name", F.lit(x)) for x in "abcd"]
    tail = F.when(F.col("c_acctbal") >= 0, "stays well above zero").otherwise("does not drop below nothing")
    point = F.concat_ws(" ", F.lit("customers in nation"), *of, F.lit("balance segment"), "c_mktsegment", tail)
    sure = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return rows.select(F.col("c_custkey").alias("finding_id"), point.alias("point"), sure.alias("confidence"), F.concat(F.lit("docs/"), F.col("c_custkey").cast("string")).alias("file"))


_SHARE = "len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))"
_START = f"list_distinct(list_filter({WORDS.format('point')}, lambda w: length(w) >= 3)[1:5])"
#: Groups are what similar classes reach; a group's lead is its surest finding, the smallest id on ties.
_BALANCE_GROUPS = f"""RECURSIVE s AS (SELECT c_custkey AS id, {_BALANCE} AS point, c_custkey % 3 AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey),
  t AS MATERIALIZED (SELECT min(id) AS id, point, list_distinct({WORDS.format('point')}) AS w, {_START} AS b, length(point) AS n FROM s GROUP BY point),
  e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.id <> b.id AND {_SHARE} >= 0.7 AND list_has_any(a.b, b.b) AND least(a.n, b.n) >= 0.5 * greatest(a.n, b.n)),
  r AS (SELECT id AS node, id AS root FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
  g AS (SELECT node, min(root) AS g FROM r GROUP BY node),
  m AS MATERIALIZED (SELECT g.g, count(*) AS n, arg_min({{'id': s.id, 'point': s.point, 'rank': s.rank}}, s.rank * 10000000000 + s.id) AS lead FROM s JOIN t USING (point) JOIN g ON g.node = t.id GROUP BY g.g)"""


@query(f"""WITH {_BALANCE_GROUPS}, l AS (SELECT {_NEG.format('lead.point')} AS neg, list_distinct({WORDS.format('lead.point')}) AS w FROM m),
  o AS (SELECT count(*) AS n FROM l a JOIN l b ON NOT a.neg AND b.neg AND {_SHARE} >= 0.4)
  SELECT CAST(sum(n) AS BIGINT) AS total_findings, CAST(count(*) AS BIGINT) AS unique_findings, CAST(0 AS BIGINT) AS verification_required, round(1 - count(*) / sum(n), 6) AS deduplication_ratio, CAST(0 AS BIGINT) AS filtered_deleted,
    CAST((SELECT n FROM o) AS BIGINT) AS contradictions FROM m""")
def aggregate_findings_defaults(spark, sf_dir):
    """The whole reduce at its defaults, 0.7 and 0.4, over statements that form real groups, as its row of counts."""
    return reduce.aggregate_findings(_balances(spark, sf_dir), "balance").counts


@query(f"""WITH {_BALANCE_GROUPS} SELECT CAST(row_number() OVER (ORDER BY lead.rank, lead.id) AS BIGINT) AS place, '[' || CASE lead.rank WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END || '] ' || lead.point AS line FROM m ORDER BY lead.rank, lead.id LIMIT 10""")
def format_summary_defaults(spark, sf_dir):
    """The report's first lines over the same groups."""
    return reduce.summary(reduce.aggregate_findings(_balances(spark, sf_dir), "balance").findings)


@query(f"""WITH {_SAID}, g AS (SELECT point, bool_or(verify) AS verify, min(CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END * 10000000000 + finding_id) AS lead FROM k GROUP BY point)
  SELECT CAST(row_number() OVER (ORDER BY lead) AS BIGINT) AS place, '[' || CASE lead // 10000000000 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END || '] ' || point || CASE WHEN verify THEN ' (to verify)' ELSE '' END AS line
  FROM g ORDER BY lead LIMIT 10""")
def format_summary(spark, sf_dir):
    """The ten findings that lead the report."""
    found, deleted = _said(spark, sf_dir)
    return reduce.summary(reduce.aggregate_findings(found, "toxic document", deleted, 0.9, 0.8).findings)


@query(f"""WITH {FINDINGS} SELECT rule, confidence, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT path) AS BIGINT) AS n_files FROM findings GROUP BY ROLLUP (rule, confidence)""")
def findings_rollup(spark, sf_dir):
    """Findings by rule and confidence with subtotals; beyond the reference."""
    return analyse.findings(dealt(files(spark, sf_dir))).rollup("rule", "confidence").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_files"))


@query(f"""WITH {FILES}, c AS (SELECT path, text, unnest(range(0, n_chars, 1000)) AS start FROM files), n AS (SELECT path, start, row_number() OVER (ORDER BY path, start) AS no FROM c)
  SELECT path, CAST(start AS BIGINT) AS start, CAST(no AS BIGINT) AS no, CAST((no - 1) // 5 + 1 AS BIGINT) AS batch FROM n""")
def map_batches(spark, sf_dir):
    """Chunks dealt to batches of five."""
    chunks = chunking.chunk_fixed(files(spark, sf_dir), 1000, 0, strict=False).select("path", "start")
    return analyse.numbered_batches(chunks, [F.col("path"), F.col("start")]).select("path", "start", F.col("no").cast("long").alias("no"), "batch")


@query(f"""WITH {FILES}, c AS (SELECT path, text, unnest(range(0, n_chars, 1000)) AS start FROM files)
  SELECT path, CAST(start AS BIGINT) AS start FROM c ORDER BY path, start LIMIT 5 OFFSET 10""")
def map_page(spark, sf_dir):
    """The third page of chunks; a page is the feature."""
    chunks = chunking.chunk_fixed(files(spark, sf_dir), 1000, 0, strict=False).select("path", "start")
    return analyse.page(chunks, [F.col("path"), F.col("start")], 3)


@query(f"""WITH {FILES}, c AS (SELECT path, substr(text, start + 1, 1000) AS content, start FROM (SELECT path, text, unnest(range(0, n_chars, 1000)) AS start FROM files))
  SELECT {SHA.format("path || '|' || start || '|' || content")} AS chunk_id, 'success' AS status, CAST({" + ".join(f"len(regexp_extract_all(content, '{r.pattern}'))" for r in analyse.RULES)} AS INTEGER) AS n_findings FROM c""")
def process_map_phase(spark, sf_dir):
    """Every chunk's result of the rule pack."""
    chunks = chunking.chunk_fixed(dealt(files(spark, sf_dir)), 1000, 0, strict=False)
    return analyse.run_map(chunks).select("chunk_id", "status", F.size("findings").alias("n_findings"))


@query("""WITH f AS (SELECT event_id, user_id FROM events WHERE event_type IN ('error', 'view') AND event_id % 4 >= 2)
  SELECT event_id AS no, user_id AS chunk_id, 'stronger' AS tier FROM f ORDER BY event_id LIMIT (SELECT least(CAST(floor(0.15 * count(*)) AS BIGINT), 500) FROM events)""")
def escalate(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    failure = F.when(F.col("event_type") == "error", "quality_low").when(F.col("event_type") == "view", "complexity").otherwise("timeout")
    failed = rows.select(F.col("event_id").alias("no"), F.col("user_id").alias("chunk_id"), failure.alias("failure"), (F.col("event_id") % 4).alias("attempt"))
    return sessions.escalate(failed, rows.count()).select("no", "chunk_id", "tier")


@query(f"""WITH {_ATTEMPTS}, l AS (SELECT chunk_id, arg_max(status, (processed_at, event_id)) AS status FROM a GROUP BY chunk_id)
  SELECT c_custkey AS chunk_id, coalesce(status, 'pending') AS status FROM customer LEFT JOIN l ON c_custkey = chunk_id""")
def restore_checkpoint(spark, sf_dir):
    chunks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"))
    return sessions.restored(chunks, sessions.latest(attempts(spark, sf_dir), order=("processed_at", "event_id")).select("chunk_id", "status"))


@query("SELECT o_orderkey AS session_id, o_orderdate AS mtime FROM orders ORDER BY mtime DESC, session_id LIMIT 1")
def resume_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("mtime"))
    return rows.agg(F.max_by(F.struct("session_id", "mtime"), F.struct("mtime", -F.col("session_id"))).alias("s")).select("s.*")


@query(f"""WITH {_ATTEMPTS}, u AS (SELECT chunk_id, status, event_id FROM a WHERE event_id % 2 = 0 UNION ALL SELECT chunk_id, status, event_id FROM a WHERE event_id % 3 = 0)
  SELECT status, CAST(count(DISTINCT event_id) AS BIGINT) AS n, CAST(count(*) - count(DISTINCT event_id) AS BIGINT) AS repeated FROM u GROUP BY status""")
def merge_runs(spark, sf_dir):
    """Results of two runs put together; what both have counts once."""
    rows = attempts(spark, sf_dir)
    both = rows.where("event_id % 2 = 0").unionByName(rows.where("event_id % 3 = 0"))
    per = both.groupBy("status", "event_id").agg(F.count("*").alias("c"))
    return per.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("c") - 1).alias("repeated"))


_ANSWERED = """CASE turn % 4 WHEN 0 THEN 'so FINAL({"role": "' || role || '", "f": "g(1)"}) and FINAL(x)' WHEN 1 THEN 'NEEDS_MORE(y) FINAL_VAR(role)' WHEN 2 THEN 'FINAL_VAR(nothing)' ELSE 'SEMIFINAL(' END"""


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'final' WHEN 1 THEN 'final_var' WHEN 2 THEN 'final_var_error' ELSE 'none' END AS kind,
  CASE turn % 4 WHEN 0 THEN '{"role": "' || role || '", "f": "g(1)"}' WHEN 1 THEN role WHEN 2 THEN 'no variable nothing' END AS value FROM conversations""")
def extract_final_answer(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", analyse.final_answer(F.expr(_ANSWERED), F.create_map(F.lit("role"), F.col("role"))).alias("a"))
    return rows.select("conv_id", "turn", "a.kind", "a.value")


@query("""SELECT conv_id, turn, '--- chunk ' || turn || ' of 9: find ---' || chr(10) ||
  regexp_replace(regexp_replace(text, '<!--|-->|\\]\\]>', '', 'g'), '(?i)<(/?)(system|query|content|instructions|response)>', '[\\1\\2]', 'g') || chr(10) || '--- end of chunk ---' AS prompt FROM conversations""")
def sequential_prompt(spark, sf_dir):
    made = analyse.sequential_prompt(F.col("text"), "find", F.col("turn"), F.lit(9))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("prompt"))


@query(f"""WITH {FILES}, t AS (SELECT path, list_distinct({WORDS.format('text')}) AS w, n_chars FROM files), q AS (SELECT list_distinct({WORDS.format("'the of and in a license'")}) AS q)
  SELECT path, round(len(list_intersect(w, q)) / (len(w) + len(q) - len(list_intersect(w, q))), 6) AS jaccard, n_chars <= 46 AND n_chars >= 11.5 AND len(list_intersect(w, q)) > 0 AS alike FROM t, q""")
def can_be_similar(spark, sf_dir):
    """Each text beside a query's words."""
    words = F.lit("the of and in a license")
    return dealt(files(spark, sf_dir)).select("path", F.round(fn.jaccard(F.col("text"), words), 6).alias("jaccard"), fn.can_be_similar(F.col("text"), words).alias("alike"))


@query("""SELECT session_id, CAST(count(*) FILTER (regexp_full_match(session_id, '[a-zA-Z0-9_-]+')) AS BIGINT) AS valid, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT CASE WHEN event_id % 3 = 0 THEN '../' ELSE 's-' END || event_type || CASE WHEN event_id % 5 = 1 THEN chr(10) WHEN event_id % 5 = 2 THEN 'ä' ELSE '' END AS session_id FROM events) GROUP BY 1""")
def validate_session_hash(spark, sf_dir):
    tail = F.when(F.col("event_id") % 5 == 1, "\n").when(F.col("event_id") % 5 == 2, "ä").otherwise("")
    name = F.concat(F.when(F.col("event_id") % 3 == 0, "../").otherwise("s-"), "event_type", tail)
    rows = table(spark, sf_dir, "events").select(name.alias("session_id"))
    return rows.groupBy("session_id").agg(F.count_if(fn.valid_session(F.col("session_id"))).alias("valid"), F.count("*").alias("n"))


# Shapes of patterns (W stands for a word of the row) and whether they are safe.
_SHAPES = (
    ("(W+)+", False), ("(W*)+", False), ("(W+)*", False), ("(W*)*", False), ("(?:W+)+", False), ("(?:W*)+", False), ("(?P<name>W+)+", False), ("(?P<name>W*)+", False), ("(W|W)+", False), ("(W|W)*", False),
    ("([a-z]+)+W", False), ("(.*){5}W", False), ("(W){2,}", False), ("(W|Wx)+", False), (".*W.*", True), ("W|[0-9]+", True), ("(W)+x", True), ("[0-9]{2,}W", True),
    ("(?:W(?:W)?){20}b", False), ("x?.*x?.*x?.*x?.*W#", False), ("(?:x{0,900})(?:x{0,900})#W", False), ("(?:a?b?)*#W", False), (r"\s*\n?\s*\n?\s*\n?\s*W", False), ("x?x?x?x?x?x?x?x?x?x?x?x?x?x?x?x?x?x?W", False),
    ("(?:W(?:W)?){3}b", True), ("W.*[0-9]{4}", True), (r"\w+\s*=\s*W", True), (r"[0-9]{5}-?[0-9]{5}-?W", True), ("(?:(?:a|b)W)*d", True), ("x{2,9}W[0-9]{1,3}", True),
)
_SHAPE_ROWS = ", ".join(f"({k}, '{shape}', {safe})" for k, (shape, safe) in enumerate(_SHAPES))


@query(f"""WITH s AS (SELECT * FROM (VALUES {_SHAPE_ROWS}) AS v(k, shape, safe)), p AS (SELECT p_partkey % {len(_SHAPES)} AS k, split_part(p_name, ' ', 1) AS w FROM part)
  SELECT replace(shape, 'W', w) AS pattern, safe, CAST(count(*) AS BIGINT) AS n FROM p JOIN s USING (k) GROUP BY 1, 2""")
def safe_patterns(spark, sf_dir):
    """Patterns written for words of part names, and whether they may be run."""
    shapes = F.array(*[F.lit(shape) for shape, _ in _SHAPES])
    shape = F.element_at(shapes, (F.col("p_partkey") % len(_SHAPES) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.replace(shape, F.lit("W"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("pattern"))
    return rows.groupBy("pattern").agg(F.count("*").alias("n")).select("pattern", fn.safe_regex(F.col("pattern")).alias("safe"), "n")


#: Documents to a file of the tree, so that files don't grow with the table: a file's text is one value, held whole.
TREE_FILE = 2_000


def _as_tree(spark: SparkSession, sf_dir: str, most: int = 0) -> str:
    """The documents as a folder of text files, one for each source and language, or for each ``most`` documents of it; German ones hold a NUL."""
    rows = table(spark, sf_dir, "documents").select("source", "lang", F.concat("text", F.when(F.col("lang") == "de", "\0").otherwise("")).alias("text"))
    path = new_path(spark, "tree")
    rows.repartition("source", "lang").write.option("maxRecordsPerFile", most).partitionBy("source", "lang").text(path)
    return path


@query("""SELECT 'source=' || source || '/lang=' || lang AS folder, CASE lang WHEN 'de' THEN 'binary' ELSE 'read' END AS reason, CAST(sum(octet_length(encode(text)) + 1 + CAST(lang = 'de' AS INTEGER)) AS BIGINT) AS size,
  CAST(sum(CASE WHEN lang <> 'de' THEN length(text) + 1 ELSE 0 END) AS BIGINT) AS n_chars FROM documents GROUP BY source, lang""")
def scan_full(spark, sf_dir):
    """A folder of files written from the documents, read back; files that hold NUL have a reason instead of a text."""
    rows = src.scan_files(spark, _as_tree(spark, sf_dir, TREE_FILE), most_bytes=1 << 30).where("name like 'part-%'")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    n_chars = F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long")
    return rows.groupBy(folder.alias("folder"), F.coalesce("reason", F.lit("read")).alias("reason")).agg(F.sum("size").alias("size"), n_chars.alias("n_chars"))


@query("""SELECT 'source=' || source || '/lang=' || lang AS folder, CASE lang WHEN 'de' THEN 'binary' ELSE 'read' END AS reason, CAST(sum(octet_length(encode(text)) + 1 + CAST(lang = 'de' AS INTEGER)) AS BIGINT) AS size,
  CAST(sum(CASE WHEN lang <> 'de' THEN length(text) + 1 ELSE 0 END) AS BIGINT) AS n_chars FROM documents WHERE lang <> 'fr' GROUP BY source, lang""")
def scan_tree(spark, sf_dir):
    """The same folder through the tree source; the folders of one language are pruned while listing."""
    rows = tree_source.scan_tree(spark, _as_tree(spark, sf_dir, TREE_FILE), dirs="lang=fr", globs="_SUCCESS,.*", mostBytes=1 << 30)
    n_chars = F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long")
    return rows.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.coalesce("reason", F.lit("read")).alias("reason")).agg(F.sum("size").alias("size"), n_chars.alias("n_chars"))


@query("""SELECT 'source=' || source || '/lang=' || lang AS folder FROM documents GROUP BY source, lang ORDER BY source, lang LIMIT 50""")
def scan_lazy_bounded(spark, sf_dir):
    """The folder's structure within the documented bounds: three levels, the first 50 files by path."""
    rows = src.scan_lazy(spark, _as_tree(spark, sf_dir))
    return rows.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"))


@query("""SELECT 'source=' || source || '/lang=' || lang AS folder, CAST(sum(octet_length(encode(text)) + 1 + CAST(lang = 'de' AS INTEGER)) AS BIGINT) AS size FROM documents GROUP BY source, lang""")
def scan_lazy(spark, sf_dir):
    """The same folder's structure, without its texts."""
    rows = src.scan_lazy(spark, _as_tree(spark, sf_dir), depth=3, most=None).where("name like 'part-%'")
    return rows.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.sum("size").alias("size"))


@query(f"""WITH {FILES}, c AS (SELECT source, n_chars, unnest(range(0, n_chars, 1000)) AS start FROM files)
  SELECT source AS session_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(least(start + 1000, n_chars) - start) AS BIGINT) AS n_chars FROM c GROUP BY source""")
def write_chunks(spark, sf_dir):
    """Chunks written to a folder for each session (here: source) and read back."""
    rows, path = files(spark, sf_dir), new_path(spark, "chunks")
    src.write_chunks(chunking.chunk_fixed(rows, 1000, 0, strict=False).withColumn("session_id", F.split_part("path", F.lit("/"), F.lit(1))), path)
    return spark.read.parquet(path).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).cast("long").alias("n_chars"))


@query("""SELECT CASE WHEN turn % 3 = 2 THEN 'unreadable' ELSE 'read' END AS kind, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1""")
def read_results(spark, sf_dir):
    """Lines of results, every third broken, read from a file."""
    body = F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.lit("success").alias("status")))
    path = new_path(spark, "lines")
    table(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 3 == 2, "{ no json").otherwise(body).alias("value")).write.text(path)
    good, bad = src.read_results(spark, path)
    both = good.select(F.lit("read").alias("kind")).unionByName(bad.select(F.lit("unreadable").alias("kind")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {_ATTEMPTS}, l AS (SELECT chunk_id, arg_max(status, (processed_at, event_id)) AS status FROM a GROUP BY chunk_id) SELECT 's-1' AS session_id, 'what failed' AS query, chunk_id, status FROM l""")
def export_results(spark, sf_dir):
    """The last results of all chunks exported as lines of JSON and read back."""
    last, path = sessions.latest(attempts(spark, sf_dir), order=("processed_at", "event_id")).select("chunk_id", "status"), new_path(spark, "export")
    src.export_results(last, "s-1", "what failed", None, path)
    lines = spark.read.schema("session_id string, query string, result struct<chunk_id: bigint, status: string>").json(path)
    return lines.select("session_id", "query", "result.chunk_id", "result.status")


@query("SELECT event_type AS event, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def progress_log(spark, sf_dir):
    """Events appended to the progress log, which is then followed as a stream to its end."""
    folder = new_path(spark, "progress")
    rows = table(spark, sf_dir, "events")
    src.emit(rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("chunk_id"), F.lit(0).cast("long").alias("batch"), F.col("props").alias("data")), folder)
    counts = ev.progress(spark, folder).groupBy("event").agg(F.count("*").alias("n"))
    return _drained(spark, counts, "complete", "event string, n long")


def _drained(spark: SparkSession, stream: DataFrame, mode: str, schema: str) -> DataFrame:
    """What a stream has given when its input is used up."""
    out, log = new_path(spark, "drained"), new_path(spark, "log")

    def save(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={no}")

    stream.writeStream.outputMode(mode).foreachBatch(save).trigger(availableNow=True).option("checkpointLocation", log).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folder = table(spark, sf_dir, "events"), new_path(spark, "events")
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Tumbling windows over a stream of events, with a watermark."""
    got = _drained(spark, ev.tumbling(_event_stream(spark, sf_dir)), "complete", "start timestamp, event_type string, n long, total double")
    return got.withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@query("""WITH f AS (SELECT user_id, ts, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM events),
  r AS (SELECT user_id, ts, failed, count(*) FILTER (failed) OVER (PARTITION BY user_id, k ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM f)
  SELECT user_id, CAST(run AS BIGINT) AS run, ts FROM r WHERE failed AND run >= 2""")
def stream_failure_runs(spark, sf_dir):
    """Failures in a row by user, kept as state over a stream of events."""
    tries = _event_stream(spark, sf_dir).select("user_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return _drained(spark, ev.failure_runs(tries), "append", "user_id long, run long, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"WITH {_MANIFESTS} SELECT file_path, change FROM delta WHERE change IS NOT NULL")
def manifest_saved(spark, sf_dir):
    """A manifest saved, loaded and compared with the present files."""
    before, now = _versions(spark, sf_dir)
    path = new_path(spark, "manifest")
    incremental.manifest(before).write.parquet(path)
    return incremental.diff(incremental.load_manifest(spark, path), incremental.manifest(now))


@query(f"""WITH {FILES}, c AS (SELECT path, start, n_chars, substr(text, start + 1, 50000) AS content FROM (SELECT path, text, n_chars, unnest(range(0, n_chars, 50000)) AS start FROM files))
  SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS processed, CAST(0 AS BIGINT) AS failed, 100.0::DOUBLE AS percent, CAST(sum({" + ".join(f"len(regexp_extract_all(content, '{r.pattern}'))" for r in analyse.RULES)}) AS BIGINT) AS n_findings FROM c""")
def session_run(spark, sf_dir):
    """A session from its start through scan, chunks and map; its status and how many findings its results hold."""
    s = sessions.Session.init(spark, new_path(spark, "sessions"), "what is in the files", model.Config(chunk_size=50_000, batch_size=1_000), "s-1")
    s.scan(dealt(files(spark, sf_dir)))
    chunks = s.chunk(force=True)
    found = s.map()
    return s.status(chunks).withColumn("n_findings", F.lit(found.agg(F.sum(F.size("findings"))).first()[0]).cast("long"))


_TRIED = f"""{FILES}, c AS (SELECT doc_id, unnest(range(0, n_chars, 50000)) AS start FROM files),
  n AS (SELECT *, doc_id % 7 = 0 AS hard, doc_id % 7 = 1 AS late FROM c), total AS (SELECT count(*) AS n FROM n),
  a AS (SELECT 1 AS attempt, CASE WHEN hard THEN 'complexity' WHEN late THEN 'timeout' END AS failure, NULL AS tier FROM n
    UNION ALL SELECT 2, CASE WHEN hard THEN 'complexity' END, NULL FROM n WHERE hard OR late UNION ALL SELECT 3, NULL, 'stronger' FROM n WHERE hard)"""


def _hard_session(spark: SparkSession, sf_dir: str) -> sessions.Session:
    """A session whose analyser fails on every seventh file, however often, and on every other seventh once."""
    s = sessions.Session.init(spark, new_path(spark, "sessions"), "what fails", model.Config(chunk_size=50_000, batch_size=2_500, max_escalation_ratio=0.5, max_cost=1e9), "s-1")
    s.scan(dealt(files(spark, sf_dir)))
    s.chunk(force=True)
    of = F.regexp_extract("path", r"doc_([0-9]+)", 1).cast("long") % 7
    said = F.when(of == 0, "the chunk is too complex").when((of == 1) & (F.col("attempt") == 1), "no answer, timeout")

    def weak(chunks: DataFrame) -> DataFrame:
        found = analyse.run_map(chunks).join(chunks.select("chunk_id", said.alias("error")), "chunk_id")
        return found.withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise("success"))

    s.map(weak, analyse.run_map)
    return s


@query(f"""WITH {_TRIED} SELECT CAST(attempt AS INTEGER) AS attempt, CASE WHEN failure IS NULL THEN 'success' ELSE 'failed' END AS status, failure, tier, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY ALL""")
def session_attempts(spark, sf_dir):
    """Attempts of a session whose analyser fails: timeouts are tried again, complex chunks escalate at the third."""
    return _hard_session(spark, sf_dir).attempts().groupBy("attempt", "status", "failure", "tier").agg(F.count("*").alias("n"))


@query(f"""WITH {_TRIED}, k AS (SELECT attempt, count(*) AS n FROM a GROUP BY attempt), b AS (SELECT CAST(sum(ceil(n / greatest(2500, ceil(n / 100)))) AS BIGINT) AS n FROM k)
  SELECT 'chunk_complete' AS event, CAST(count(*) AS BIGINT) AS n FROM a UNION ALL SELECT 'escalation', CAST(count(*) AS BIGINT) FROM a WHERE tier IS NOT NULL
  UNION ALL SELECT 'batch_start', n FROM b UNION ALL SELECT 'batch_end', n FROM b""")
def session_events(spark, sf_dir):
    """The map's progress log of the same session, followed as a stream to its end; findings are counted in ``session_run``."""
    log = ev.progress(spark, _hard_session(spark, sf_dir).progress())
    counts = log.where("event <> 'finding'").groupBy("event").agg(F.count("*").alias("n"))
    return _drained(spark, counts, "complete", "event string, n long")


@query(f"WITH {_MANIFESTS} SELECT path AS file_path, 'added' AS change, 1 AS listing FROM m0 UNION ALL SELECT file_path, change, 2 FROM delta WHERE change IS NOT NULL")
def follow_listings(spark, sf_dir):
    """Two listings of the tree followed as a stream: what came, changed and went, deletes told by timers."""
    folder, out, log = (new_path(spark, what) for what in ("listings", "changes", "log"))
    for day, rows in enumerate(_versions(spark, sf_dir), 1):
        incremental.listing(rows, f"2024-01-0{day}").write.mode("append").parquet(folder)
        incremental.watch_listings(spark, folder, f"{out}/listing={day}", log).awaitTermination()
    return spark.read.schema("file_path string, change string, listing int, batch long").parquet(out).select("file_path", "change", "listing")


@query("""WITH p AS (SELECT CASE event_id % 6 WHEN 0 THEN '/' WHEN 1 THEN '../' WHEN 2 THEN 'a/../../' WHEN 3 THEN 'a..b/' WHEN 4 THEN chr(92) ELSE './' END || event_type || '/' || user_id AS path FROM events)
  SELECT path, NOT (starts_with(replace(path, chr(92), '/'), '/') OR list_contains(string_split(replace(path, chr(92), '/'), '/'), '..')) AS inside, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL""")
def path_containment(spark, sf_dir):
    """Paths of which some lead out of their root."""
    lead = F.element_at(F.array(*map(F.lit, ("/", "../", "a/../../", "a..b/", "\\", "./"))), (F.col("event_id") % 6 + 1).cast("int"))
    path = F.concat(lead, "event_type", F.lit("/"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(path.alias("path")).groupBy("path").agg(F.count("*").alias("n")).select("path", src.is_contained(F.col("path")).alias("inside"), "n")


_SHOWN = "CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f', size / 1024.0) || ' KB' ELSE printf('%.1f', size / 1048576.0) || ' MB' END"


@query(f"""WITH {FILES}, d AS (SELECT source AS name, sum(n_chars) AS size, row_number() OVER (ORDER BY lower(source), source) AS i, count(*) OVER () AS n FROM files GROUP BY source)
  SELECT CAST(i AS BIGINT) AS no, CASE WHEN i = n THEN '└── ' ELSE '├── ' END || name || '/ (' || {_SHOWN} || ')' AS line FROM d
  UNION ALL SELECT CAST(max(n) + 1 AS BIGINT), '0 files, ' || max(n) || ' directories' FROM d""")
def tree_view(spark, sf_dir):
    """The top level of the tree as text, a row for each line."""
    lines = src.tree_view(files(spark, sf_dir), depth=1).split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "no long, line string")


@query(f"""WITH {FILES}, f AS (SELECT lang AS name, sum(n_chars) AS size FROM (SELECT path, n_chars, split_part(path, '/', 1) AS source, split_part(path, '/', 2) AS lang FROM files) WHERE source = (SELECT min(source) FROM files) GROUP BY lang),
  d AS (SELECT *, row_number() OVER (ORDER BY lower(name), name) AS i, count(*) OVER () AS n FROM f)
  SELECT CAST(i AS BIGINT) AS no, CASE WHEN i = n THEN '└── ' ELSE '├── ' END || name || '/ (' || {_SHOWN} || ')' AS line FROM d UNION ALL SELECT CAST(max(n) + 1 AS BIGINT), '0 files, ' || max(n) || ' directories' FROM d""")
def preview_dir(spark, sf_dir):
    """One directory's first level, a row for each line."""
    rows = files(spark, sf_dir)
    lines = src.preview_dir(rows, rows.agg(F.min("source")).first()[0] or "none", depth=1).split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "no long, line string")


@query(f"""WITH {FILES}, e AS (SELECT source AS path, true AS is_dir FROM files UNION SELECT source || '/' || split_part(path, '/', 2), true FROM files UNION ALL SELECT path, false FROM files)
  SELECT path, is_dir FROM (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS name FROM e) ORDER BY parent, is_dir DESC, lower(name), name LIMIT 50""")
def tree_cap(spark, sf_dir):
    """The first entries of the listing, of which it has too many."""
    return src.tree(files(spark, sf_dir), depth=3, most=50).select("path", "is_dir")


@query(f"""WITH {FILES}, c AS (SELECT source, unnest(range(0, n_chars, 1000)) AS start FROM files) SELECT 'placeholder' AS status, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_findings FROM c""")
def placeholder_results(spark, sf_dir):
    """Results of chunks that no analyser has seen."""
    made = analyse.placeholders(chunking.chunk_fixed(files(spark, sf_dir), 1000, 0, strict=False))
    return made.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size("findings")).cast("long").alias("n_findings"))


@query(f"""WITH c AS (SELECT conv_id || '-' || turn AS chunk_id, row_number() OVER (ORDER BY conv_id, turn) AS no, text AS content, CASE WHEN turn % 3 = 0 THEN 'failed' ELSE 'pending' END AS status, count(*) OVER () AS n FROM conversations)
  SELECT chunk_id, concat_ws(chr(10), '<system>{analyse.FOCUS["architecture"]}</system>', '<query>what is said</query>', '<position>' || no || ' of ' || n || '</position>', '<instructions>{analyse.DUTIES}</instructions>',
    '<content>' || {_SAFE.format("content")} || '</content>', '<format>{analyse.FORMAT}</format>') AS prompt FROM c WHERE status = 'failed' ORDER BY no LIMIT 5 OFFSET 5""")
def map_instructions(spark, sf_dir):
    """Prompts for the second page of the chunks that failed."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), "conv_id", "turn", F.col("text").alias("content"), F.when(F.col("turn") % 3 == 0, "failed").otherwise("pending").alias("status"))
    numbered = stage(running_sum(rows, F.lit(1), [F.col("conv_id"), F.col("turn")], "no"), "numbered-turns")
    return analyse.map_instructions(numbered, "what is said", 2, 5, True, "architecture")


@query("""WITH l AS (SELECT lang, count(*) AS n, count(*) FILTER (doc_id % 5 <> 0) AS ok, count(*) FILTER (doc_id % 5 = 0) AS failed, row_number() OVER (ORDER BY lang) AS i FROM documents WHERE lang IS NOT NULL GROUP BY lang)
  SELECT 's-' || lang AS session_id, CASE i WHEN 1 THEN 'completed' WHEN 2 THEN 'initialized' ELSE 'reducing' END AS phase, CASE i WHEN 1 THEN n || ' documents' END AS final_answer, CAST(n AS BIGINT) AS total, CAST(CASE i WHEN 2 THEN 0 ELSE ok END AS BIGINT) AS processed,
    CAST(CASE i WHEN 2 THEN 0 ELSE failed END AS BIGINT) AS failed, CAST(CASE i WHEN 2 THEN 0 ELSE 2 END AS BIGINT) AS notes FROM l WHERE i <= 3""")
def session_lifecycle(spark, sf_dir):
    """Sessions of the first languages through their life: results and notes come, one is completed, one reset, a fourth one removed; what the list and the status then say."""
    docs, root = table(spark, sf_dir, "documents").where("lang is not null"), new_path(spark, "sessions")
    langs = [r["lang"] for r in docs.select("lang").distinct().orderBy("lang").limit(3).collect()]
    sessions.Session.init(spark, root, "nothing", session_id="gone").clean()
    rows = []
    for k, lang in enumerate(langs):
        s = sessions.Session.init(spark, root, f"what is written in {lang}", session_id=f"s-{lang}")
        chunks = docs.where(F.col("lang") == lang).select(F.col("doc_id").cast("string").alias("chunk_id"), F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("success").alias("status"))
        s.add_results(chunks.withColumn("processed_at", F.current_timestamp()))
        s.add_note("one")
        s.add_note("two")
        s.set_phase("reducing")
        if k == 0:
            s.set_final_answer(f"{chunks.count()} documents")
        if k == 1:
            s.reset()
        rows.append(s.status(chunks).select(F.lit(s.session_id).alias("session_id"), "total", "processed", "failed", F.lit(s.notes().count()).cast("long").alias("notes")))
    state = rows[0]
    for more in rows[1:]:
        state = state.unionByName(more)
    return sessions.Session.every(spark, root).select("session_id", "phase", "final_answer").join(state, "session_id")
