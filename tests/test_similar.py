"""What similar sets cost: rare words are told from common ones, and what can't be alike is dropped before sets are fetched."""

import random

from pyspark.sql import functions as F

from corpusloom.plans import reduce


def _classes(spark, sets):
    return spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "class_id long, t array<long>")


def test_words_of_one_set_are_in_no_prefix(spark):
    r = random.Random(1)
    word = lambda: r.getrandbits(63)
    common = [word() for _ in range(30)]
    sets = [{*common, *(word() for _ in range(20))} for _ in range(3000)]
    # The first two share their 20 rare words, too.
    sets[1] = {*sets[0]}
    pre = reduce.prefixes(_classes(spark, sets), 0.7)
    # Prefixes have 16 words; of 20 rare ones most are alone in their slot of the table.
    assert pre.count() < 3000 * 16 / 2
    assert pre.where("class_id > 1").join(pre.select("h", F.col("class_id").alias("o")), "h").where("class_id <> o").count() == 0
    assert pre.where("class_id < 2").groupBy("h").count().where("count = 2").count() == 16


def test_signs_drop_no_similar_sets_and_most_others(spark):
    r = random.Random(2)
    every = [r.getrandbits(64) - (1 << 63) for _ in range(3000)]
    sets = [set(r.sample(every, r.choice((3, 40, 90, 150, 500)))) for _ in range(60)]
    sets += [set(list(s)[: int(len(s) * r.uniform(0.6, 1))]) | set(r.sample(every, len(s) // 10)) for s in sets]
    known = reduce.signed(_classes(spark, sets))
    a, b = (known.select(*[F.col(c).alias(f"{c}_{side}") for c in known.columns]) for side in "ab")
    for least in (0.4, 0.7):
        near = {(x.a, x.b) for x in a.join(b, F.col("class_id_a") < F.col("class_id_b")).where(reduce.near_enough(least)).select(F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b")).collect()}
        pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
        alike = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}
        assert alike and alike <= near
        assert least < 0.7 or len(near) < len(pairs) * 0.3


def test_opposed_statements_meet_by_what_they_must_share(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(14)]
    rows = [(k, " ".join(r.sample(words, r.choice((1, 2, 3, 4, 5, 8, 9, 12))) + r.choice(([], ["not", "seen"])))) for k in range(400)]
    findings = spark.createDataFrame(rows, "finding_id long, point string")
    first: dict = {}
    for k, p in rows:
        w = frozenset(p.split())
        first.setdefault(("not" in w, w), [k, 0])[1] += 1
    for least in (0.4, 0.8):
        got = {(x.a, x.b): (round(x.similarity, 9), x.n_a, x.n_b) for x in reduce.contradictions(findings, least).collect()}
        want = {}
        for (na, wa), (a, ca) in first.items():
            for (nb, wb), (b, cb) in first.items():
                if not na and nb and len(wa & wb) >= least * len(wa | wb):
                    want[a, b] = (round(len(wa & wb) / len(wa | wb), 9), ca, cb)
        assert got == want and got


def test_small_statements_make_no_prefixes(spark, monkeypatch):
    """Words of statements of a few words are all frequent; pairs that share one alone would be most of all pairs."""
    monkeypatch.setattr(reduce, "prefixes", None)
    said = [(k, f"{'not ' if k % 2 else ''}seen u{k // 2 % 7} h{k // 14 % 5} d{k // 70}") for k in range(500)]
    found = reduce.contradictions(spark.createDataFrame(said, "finding_id long, point string"))
    assert found.where("similarity < 0.4").isEmpty() and found.count() > 0


def test_statements_that_share_a_subset_alone_are_rated_with_it(spark, monkeypatch):
    """The words of hardly any such pair are compared."""
    said = [(k, f"{'not ' if k % 2 else ''}seen u{k} h1 d2") for k in range(60)]
    findings = spark.createDataFrame(said, "finding_id long, point string")
    want = {(x.a, x.b, round(x.similarity, 6)) for x in reduce.contradictions(findings).collect()}
    assert want == {(a, b, 0.5) for a in range(0, 60, 2) for b in range(1, 60, 2)}
    monkeypatch.setattr(reduce, "_shared", lambda a, b: F.lit(-1.0))
    known = {(x.a, x.b, x.similarity) for x in reduce.contradictions(findings).collect()}
    assert known <= want and len(known) > 0.99 * len(want)


def test_words_with_the_same_bits_are_compared(spark):
    """The fourth words have the same bits in both longs: one pair has the same word there, one another word."""
    classes = [(1, [10, 20, 30, 77], False, 2), (2, [10, 20, 30, 40, 77], True, 3), (3, [10, 20, 30, 77 + (1 << 20)], False, 1)]
    classes = spark.createDataFrame(classes, "class_id long, t array<long>, neg boolean, members long")
    got = [tuple(x) for x in reduce.opposed_small(classes, 0.4, [4], [5], digits=2).orderBy("a").collect()]
    assert got == [(1, 2, 0.8, 2, 3), (3, 2, 0.5, 1, 3)]


def test_similar_sets_share_several_rare_words(spark, monkeypatch):
    """Sets that share one rare word by chance aren't fetched; sets of a few words are, by all that they must share."""
    r = random.Random(4)
    word = lambda: r.getrandbits(64) - (1 << 63)
    once = [word() for _ in range(400)]
    sets = [{word() for _ in range(38)} | {once[k // 2], once[(k + 7) % 400]} for k in range(800)]
    sets += [s | {word() for _ in range(r.randrange(20))} for s in sets[::8]]
    small = [word() for _ in range(9)]
    sets += [set(r.sample(small, r.choice((1, 2, 3, 4)))) for _ in range(60)]
    classes = _classes(spark, sets).withColumn("b", F.array(F.lit(1).cast("long"))).withColumn("len", F.lit(1))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    want = {(i, j, round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 9)) for i, j in pairs if len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    fetched = []
    stage = reduce.stage
    monkeypatch.setattr(reduce, "near_enough", lambda least: F.lit(True))
    monkeypatch.setattr(reduce, "stage", lambda df, what: fetched.append((what, out := stage(df, what))) or out)
    got = {(x.a, x.b, round(x.similarity, 9)) for x in reduce.similar_classes(classes, 0.7).collect()}
    assert got == want and len(want) > 100
    # 400 words bring two sets together each, and 800 places two neighbours more.
    assert dict(fetched)["candidates"].count() < 1.2 * len(want)


def test_the_table_of_levels_is_in_no_row(spark):
    """Each row would hold a copy, of 16 MB for large tables."""
    sets = [{k, k + 1, k + 2} for k in range(50)]
    node = reduce.prefixes(_classes(spark, sets), 0.7)._jdf.queryExecution().optimizedPlan()
    while True:
        assert "rarity" not in node.output().toString()
        if node.children().isEmpty():
            break
        node = node.children().head()


def test_words_of_a_level_are_in_order_of_their_hashes(spark):
    sets = [{-5, 7, 1 << 40}, {-5, 7, 1 << 40}]
    rows = reduce.prefixes(_classes(spark, sets), 0.0).orderBy("class_id", "at").collect()
    first = [x.h for x in rows if x.class_id == 0]
    assert first == sorted(first) and len(first) == 3 and first == [x.h for x in rows if x.class_id == 1]


def test_cells_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    """Their bytes are few, their work isn't: put together by bytes, they would be one task."""
    monkeypatch.setattr(reduce, "CELL", 20)
    rows = spark.createDataFrame([(k, f"same start {k:06d} " + "x" * (k % 7)) for k in range(200)], "id long, text string")
    cells = reduce._cells(rows, "id", "text", 0.7, 0.5)
    n = cells.select("big", "deal", "low", "high").distinct().count()
    assert n > 20 and n / 2 <= cells.rdd.getNumPartitions() <= 8 * n
    monkeypatch.setattr(reduce, "TASKS", 5)
    assert reduce._cells(rows, "id", "text", 0.7, 0.5).rdd.getNumPartitions() == 5


def test_a_text_is_cut_into_words_once(spark):
    """For its key, its set and its start; in near_groups, where keys are made again, twice."""
    rows = spark.createDataFrame([(1, "Some Words\tof a text\n"), (2, None), (3, "some words of a text text")], "id long, text string")
    _, keys = reduce.token_sets(rows, "id", "text")
    assert keys._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    groups = reduce.near_groups(rows, "id", "text").orderBy("id").collect()
    assert [tuple(x) for x in groups] == [(1, 1, 1, 1), (2, 2, 2, 0), (3, 3, 1, 1)]
