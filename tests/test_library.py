"""Files, chunks, reduce, sessions, streams and errors on small inputs."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import catalog, errors
from corpusloom.functions import text as fn
from corpusloom.operators import analyse, chunking, incremental, sessions
from corpusloom.plans import reduce
from corpusloom.plans.components import star_components
from corpusloom.sources import files as src
from corpusloom.streaming import events as ev


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a/node_modules").mkdir(parents=True)
    (tmp_path / "a/x.py").write_text("def f():\n    return 1\n")
    (tmp_path / "a/node_modules/y.js").write_text("x")
    (tmp_path / "B.md").write_text("# title\nwörds")
    (tmp_path / "bin.dat").write_bytes(b"\x00\x01")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    return str(tmp_path)


def test_scans(spark, folder):
    full = src.scan_full(spark, folder)
    assert {r.path: r.text for r in full.collect()} == {"a/x.py": "def f():\n    return 1\n", "a/node_modules/y.js": "x", "B.md": "# title\nwörds"}
    assert {r.path for r in src.prune(full).collect()} == {"a/x.py", "B.md"}
    assert src.scan_lazy(spark, folder).count() == 5
    assert src.load_file(full, "B.md").count() == 1
    assert [r.path for r in src.scan_targeted(full, ["a/x.py", "a"]).where("name = 'x.py'").collect()] == ["a/x.py"]
    listed = full.withColumn("n_chars", F.length("text"))
    view = src.tree_view(listed, depth=3)
    assert view.startswith("├── a/") and "x.py" in view and view.endswith("3 files, 2 directories")


@pytest.mark.parametrize("path", ["../x", "/etc/passwd", "a/../../b", "a\0b"])
def test_paths_stay_inside(path):
    with pytest.raises(errors.CorpusError) as e:
        src.contained("/root/data", path)
    assert e.value.code == "path" and json.loads(e.value.to_json())["context"]


def test_ignore_file():
    assert src.parse_ignore(["# c", "", "dist/", "*.log"]) == (["dist"], ["*.log"])


def test_grep_spans_match_a_scan(spark):
    texts = ["a1 22é 333", "", "12", "x", "9" * 300 + " 10 \n11"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("i", fn.grep_spans(F.col("text"), "[0-9]{2,}", window=3).alias("m")).collect():
        t = texts[r.i]
        assert [(m.match, m.start, m.end, m.snippet) for m in r.m] == [(m[0], m.start(), m.end(), t[max(0, m.start() - 3) : m.end() + 3]) for m in re.finditer("[0-9]{2,}", t)][:20]


@pytest.mark.parametrize("pattern,safe", [("a+b", True), ("(a+)+", False), ("(.*)*x", False), ("(", False), ("[0-9]{2,4}", True)])
def test_regex_safety(pattern, safe):
    assert fn.is_safe_regex(pattern) is safe
    if not safe:
        with pytest.raises(errors.CorpusError):
            fn.grep(F.lit("x"), pattern)


@given(st.text(alphabet="ab\n é", max_size=200), st.integers(1, 40))
@settings(max_examples=80, deadline=None)
def test_scope_chunks_join_to_the_text(text, most):
    chunks = chunking.scope_chunks(text, None, most)
    assert "".join(c[2] for c in chunks) == text
    assert all(c[1] >= c[0] for c in chunks)


def test_scopes_of_python():
    text = "import x\n\n@d\ndef f():\n    pass\n\nclass A:\n    y = 1\n"
    assert chunking.scope_starts(text, "python") == [3, 7]
    assert [c[:2] for c in chunking.scope_chunks(text, "python", 40)][-1] == (7, 8)


def test_chunks_join_to_the_text(spark):
    rows = [("p", ".py", "abcdefghij" * 7), ("e", ".md", ""), ("u", ".txt", "é" * 25)]
    df = spark.createDataFrame(rows, "path string, ext string, text string")
    cut = chunking.chunk_fixed(df, 20, 0, strict=False).orderBy("path", "no").collect()
    for path, _, text in rows:
        assert "".join(c.content for c in cut if c.path == path) == text
    over = [c for c in chunking.chunk_fixed(df, 20, 5, strict=False).orderBy("no").collect() if c.path == "p"]
    assert all(b.start == a.start + 15 for a, b in zip(over, over[1:])) and over[-1].end == 70
    with pytest.raises(errors.CorpusError):
        chunking.check_sizes(100_000, 100_000)
    with pytest.raises(errors.CorpusError):
        chunking.check_sizes(10, 0)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    assert {r.node: r.root for r in star_components(edges).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert star_components(edges.where("u < 0")).count() == 0


def test_components_that_are_not_settled_are_an_error(spark):
    """Too few rounds never give parts of a component; enough ones give it whole."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    with pytest.raises(errors.CorpusError):
        star_components(edges, rounds=1)
    assert {r.root for r in star_components(edges.where("u < 4"), rounds=4).collect()} == {0}
    stars = spark.createDataFrame([(0, 1), (2, 0), (3, 3), (5, 4)], "u long, v long")
    assert {r.node: r.root for r in star_components(stars, rounds=0).collect()} == {1: 0, 2: 0, 5: 4}


def test_near_groups_boundary_and_copies(spark):
    base = [f"w{i}xx" for i in range(10)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:7])), (4, " ".join(base[:6])), (5, ""), (6, None), (7, "other words here entirely")]
    got = {r.id: (r.class_id, r.group_id) for r in reduce.near_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t", 0.7).collect()}
    assert got[1] == got[2] == (1, 1) and got[3][1] == 1 and got[4][1] == 1  # 6 of 7 words join 4 to 3
    assert got[7] == (7, 7) and set(got) == {1, 2, 3, 4, 5, 6, 7}


def test_contradictions_are_found_once(spark):
    rows = [(1, "the cache is safe"), (2, "the cache is not safe"), (3, "never mind"), (4, "")]
    got = reduce.contradictions(spark.createDataFrame(rows, "finding_id long, point string"), 0.4).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


def test_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, text string")
    incremental.manifest(df).write.parquet(str(tmp_path / "m"))
    assert incremental.load_manifest(spark, str(tmp_path / "none")) is None
    now = spark.createDataFrame([("b", "3"), ("c", "1")], "path string, text string")
    delta = incremental.diff(incremental.load_manifest(spark, str(tmp_path / "m")), incremental.manifest(now))
    assert {(r.file_path, r.change) for r in delta.collect()} == {("a", "deleted"), ("b", "changed"), ("c", "added")}
    assert incremental.diff(incremental.manifest(now), incremental.manifest(now)).count() == 0
    assert {r.path for r in incremental.to_analyse(now, delta).collect()} == {"b", "c"}


def test_session(spark, tmp_path):
    s = sessions.Session.init(spark, str(tmp_path), "q", session_id="s-1")
    with pytest.raises(errors.CorpusError):
        sessions.Session.init(spark, str(tmp_path), "q", session_id="s-1")
    with pytest.raises(errors.CorpusError):
        sessions.Session(spark, str(tmp_path), "../x")
    s.set_phase("mapping")
    assert s.phase() == "mapping"
    one = spark.sql("SELECT 'c' AS chunk_id, 'failed' AS status, timestamp'2024-01-01' AS processed_at")
    s.add_results(one)
    s.add_results(one.withColumn("status", F.lit("success")).withColumn("processed_at", F.lit("2024-01-02").cast("timestamp")))
    assert [r.status for r in s.results().collect()] == ["success"]


def test_responses_and_markers(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"chunk_id": "c1", "status": "success", "findings": []}\nnot json\n')
    good, bad = src.read_results(spark, str(path))
    assert good.count() == 1 and bad.count() == 1
    row = spark.createDataFrame([("x FINAL(a) UNABLE(b)",), ("SEMIFINAL(x)",), (None,)], "t string")
    got = row.select(analyse.has_marker(F.col("t")).alias("h"), analyse.markers(F.col("t")).alias("m")).collect()
    assert [g.h for g in got] == [True, False, None] and [m.content for m in got[0].m] == ["a", "b"]
    src.export_results(good, "s", "q", None, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["session_id"] == "s"


def test_errors_table(spark):
    rows = errors.table(spark).collect()
    assert len(rows) == len({r.code for r in rows}) == len(errors.FAULTS) and all(r.exit_code in errors.EXIT.values() and r.hint for r in rows)
    for code in errors.FAULTS:
        e = errors.CorpusError(code, "x", what="y")
        assert str(e).startswith(f"[{code}] ") and json.loads(e.to_json())["hint"] == e.hint
    assert str(errors.CorpusError("chunk_size", "x", what="y")).startswith("[chunk_size] chunk size out of range")


def test_streams_equal_batches(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = ev.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("tumbled")) == key(ev.tumbling(table))
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"ts": "2024-01-01T00:00:00Z", "event": "finding", "chunk_id": "c"}\n')
    q = ev.watch(ev.progress(spark, str(log)), "watched", 1)
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("watched").collect()] == [("finding", 1)]


def test_every_query_has_a_twin_or_a_test():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"near_dup_ratio"}


UNSAFE = (
    "(a+)+", "(a*)+", "(a+)*", "(a*)*", "(?:a+)+", "(?:a*)+", "(?P<name>a+)+", "(?P<name>a*)+", "(a|a)+", "(a|a)*", "([a-z]+)+", "(.*){5}", "(abc){2,}",
    "(.*a){20}", "(a|ab)+c", ".*.*.*=", r"\w+\w+", "a{5000}", "((a+)b?)+", "(", "(?:x|xy)*z", "(a+){2,}",
)
SAFE = ("[0-9]{2,}", "(foo|bar)+", "(ab)+c", ".*error.*", r"def \w+\(", "(?:abc)?", "a{2,5}", "(a|b){3}", r"^\s*class\s+\w+", r"[(|)]+", r"\(a\|a\)+")


@pytest.mark.parametrize("pattern", UNSAFE + SAFE)
def test_unsafe_patterns(pattern):
    assert fn.is_safe_regex(pattern) == (pattern in SAFE)


@pytest.mark.parametrize("glob,fits,others", [("*.py", ["a.py", "x/y.py"], ["a.pyc"]), ("[ab]*.py", ["ax.py"], ["cx.py"]), ("[!ab].c", ["c.c"], ["a.c"]), ("a?b", ["axb"], ["ab"]), ("[]x]", ["]", "x"], ["y"]), ("x[1", ["x[1"], ["x1"]), ("[a-c]&[", ["b&["], ["d&["])])
def test_globs(spark, glob, fits, others):
    rows = spark.createDataFrame([(p,) for p in fits + others], "p string")
    assert [r.m for r in rows.select(F.col("p").rlike(fn.glob_to_regex(glob)).alias("m")).collect()] == [True] * len(fits) + [False] * len(others)


def test_session_names(spark):
    names = ["abc", "a-b_C1", "abc\n", "", "a b", "\u00e4", "../a", "a/b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.v for r in rows.select(fn.valid_session(F.col("n")).alias("v")).collect()] == [True, True] + [False] * 6


def test_staging(spark, tmp_path, monkeypatch):
    """Staged tables go when told to; settings return; a cluster without a shared folder is refused."""
    from corpusloom.plans import staging

    made = staging.stage(spark.range(5), "five")
    folder = made.inputFiles()[0].rsplit("/", 1)[0]
    fs, path = staging.file_system(spark, folder)
    assert made.count() == 5 and fs.exists(path)
    staging.drop(made)
    assert not fs.exists(path)
    name, own = "spark.sql.execution.arrow.maxBytesPerBatch", spark.newSession()  # other tests may have set theirs
    for before, inside in (("268435456", str(2 << 20)), ("1048576", "1048576")):
        own.conf.set(name, before)
        with staging.bounded_batches(own, 2):
            assert own.conf.get(name) == inside
        assert own.conf.get(name) == before

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

    with pytest.raises(errors.CorpusError, match="no_shared_folder"):
        staging.shared_dir(Cluster)


def test_hot_keys_and_centres(spark):
    """Frequent keys are joined by broadcast, the rest by shuffle; a star of one centre settles."""
    from corpusloom.plans.components import star_components
    from corpusloom.plans.staging import join_hot

    rows = spark.createDataFrame([(k, i) for k in range(6) for i in range(1 + 20 * (k < 2))], "k int, i int")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    want = sorted(map(tuple, rows.join(sizes.drop("n"), "k").collect()))
    for hot in (10, 1, 1000):
        assert sorted(map(tuple, join_hot(rows, sizes, "k", hot).collect())) == want
    star = spark.range(1, 400).select(F.lit(500).cast("long").alias("u"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(500, 0), (700, 701)], "u long, v long"))
    roots = {r.node: r.root for r in star_components(star, hot=50).collect()}
    assert roots == {k: 0 for k in [*range(1, 400), 500]} | {701: 700}
