"""What is learned or drawn stays bounded and the same on every run; models against plain versions of their steps."""

import random
import time
from collections import Counter
from math import log1p

import numpy as np
import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontam, langid, pii, quality, queries, rules, simhash, token_store
from corpusloom.llm.common import drawn
from tests.llm.test_operators import WORD, brute_leaks, docs_of

SF = "/root/testdata/sf0.001"


# --- drawing


@pytest.mark.parametrize("share", [1.0, 0.25, 1e-4, 3e-9, 0.0])
def test_shares_of_hashes(spark, share):
    low, high = -(1 << 63), (1 << 63) - 1
    edge = low + int(share * 2**64)
    rows = spark.createDataFrame([(low,), (0,), (high,), (edge - (1 << 20),) if edge - (1 << 20) > low else (low,), (min(edge + (1 << 20), high),)], "h long")
    got = [r.d for r in rows.select(drawn(F.col("h"), F.lit(share)).alias("d")).collect()]
    assert got == [True, share >= 0.5, share == 1, True, share == 1]


def test_language_sample_of_a_large_language(spark):
    """One row of two millions is still drawn; a row repeated 10^5 times is learned from once."""
    many = spark.range(2_000_001).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("en").alias("lang"))
    got = langid.sample(many, langid.Settings(per_language=1)).collect()
    assert len(got) == 1 and got == langid.sample(many.repartition(7), langid.Settings(per_language=1)).collect()
    few = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("ein text "), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    same = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("immer gleich").alias("text"), F.lit("de").alias("lang"))
    assert Counter(r.t for r in langid.sample(few.unionByName(same), langid.Settings(per_language=500)).collect())["immer gleich"] <= 1
    odd = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.concat(F.lit("l"), (F.col("id") % 300).cast("string")).alias("lang"))
    settings = langid.Settings(per_language=5, languages=20, learned=60)
    rows = langid.sample(odd, settings).collect()
    assert len(rows) <= 60 and len({r.l for r in rows}) <= 20 and max(Counter(r.l for r in rows).values()) <= 3


def test_rule_order_is_the_same_on_every_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    orders = {tuple(rules.order_rules(docs.repartition(k + 1), 100)) for k in range(5)} | {tuple(rules.order_rules(docs, 100)) for _ in range(5)}
    assert len(orders) == 1


def test_a_repeated_row_counts_once_in_the_order(spark):
    words = " ".join(f"wort{i}" for i in range(60))
    rows = docs_of(spark, [(1, words.upper(), None, None)])
    loud = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20_000)))).drop("k")
    quiet = docs_of(spark, [(10 + i, f"{words} {'#' * 9} {i}", None, None) for i in range(50)])
    assert rules.order_rules(loud.unionByName(quiet), 10**9)[0] == "symbols"


def test_rules_refuse_names_of_their_measures(spark):
    docs = docs_of(spark, [(1, "a b c", None, None)])
    with pytest.raises(Exception, match="__m"):
        rules.keep_passing(docs.withColumn("__M", F.lit(1)), list(rules.rules()))


# --- models against plain versions


def test_decoding_by_hand():
    rng = np.random.default_rng(5)
    for k in (2, 3, 4, 9):
        code = langid.codewords(k)
        trust = rng.uniform(0.1, 1, code.shape[1])
        model = langid.Model([f"l{i}" for i in range(k)], code, np.zeros((4, 1)), np.zeros(1), trust)
        for _ in range(20):
            out = rng.normal(0, 2, code.shape[1])
            loss = [sum(t * np.log(1 + np.exp(-c * o)) for t, c, o in zip(trust, row, out)) / sum(trust) for row in code]
            share = np.exp(-(np.array(loss) - min(loss)) * len(trust))
            share /= share.sum()
            name, score, ambiguous = langid.decode(model, out)
            first, second = sorted(range(k), key=lambda i: loss[i])[:2]
            assert name == f"l{first}" and score == pytest.approx(share[first]) and ambiguous == (share[first] - share[second] < 0.2)


def test_profile_by_hand():
    text = "Die Straße, 12 mal!"
    plain = [ord(c) if ("a" <= c <= "z" or "A" <= c <= "Z" or ord(c) >= 192) else 32 for c in text.lower()]
    counts, m = np.zeros(4096), 2**32
    for n in (2, 3):
        for i in range(len(plain) - n + 1):
            h = (plain[i] * 40503 + plain[i + 1]) * 2654435769 % m
            h = (h ^ plain[i + 2]) * 2246822519 % m if n == 3 else h
            counts[h >> 16 & 4095] += 1
    want = np.sqrt(counts) / np.linalg.norm(np.sqrt(counts))
    assert np.allclose(langid.profile(text, 4096), want, atol=1e-6)


def test_predictions_are_decodings(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    for r in langid.identify(docs.limit(40), model).collect():
        out = langid.profile(r.text, 4096).astype(float) @ model.weights + model.bias
        loss = np.logaddexp(0, -model.code * out) @ model.trust
        assert r.lang_pred == model.languages[int(np.argmin(loss))]


def test_word_vectors_and_pooling_by_hand(spark):
    s = quality.Settings(rows=512, dims=8, block=64)
    texts = ["one two three two one", None, "", "three", "four one\nfive  two " + "six " * 30]
    docs = docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts * 3)]).repartition(5)
    got = quality.word_vectors(docs, s)
    hasher, (place, sign) = quality.Hasher(s.rows), quality.index_vectors(s)
    number = lambda w: int(hasher(w.encode())[0])
    table = np.zeros((s.rows, s.dims))
    for t in texts * 3:
        words = WORD.findall(t or "")
        for i, w in enumerate(words):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if j != i:
                    for p, x in zip(place[number(words[j])], sign[number(words[j])]):
                        table[number(w), p] += x
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    want = table / np.where(norm > 0, norm, 1)
    assert np.allclose(got, want, atol=1e-6) and np.abs(want).sum() > 0
    for t in texts:
        vectors = [want[number(w)] for w in WORD.findall(t or "")]
        mean = np.mean(vectors, 0) if vectors else np.zeros(s.dims)
        spread = np.std(vectors, 0) if vectors else np.zeros(s.dims)
        assert np.allclose(quality.pool(t, hasher, got), [*mean, *spread, np.linalg.norm(mean), log1p(len(vectors))], atol=1e-5)


def test_network_by_hand():
    rng = np.random.default_rng(2)
    net = quality.Network(rng.normal(size=6), rng.uniform(0.5, 2, 6), rng.normal(size=(6, 4)), rng.normal(size=4), rng.normal(size=4), 0.3, 1.7)
    for x in rng.normal(size=(10, 6)):
        hidden = [np.tanh(sum((x[i] - net.mean[i]) / net.scale[i] * net.first[i, j] for i in range(6)) + net.first_bias[j]) for j in range(4)]
        logit = sum(h * w for h, w in zip(hidden, net.second)) + net.second_bias
        assert net.probability(x[None])[0] == pytest.approx(1 / (1 + np.exp(-logit / 1.7)))


# --- decontamination


def brute_rows(texts, items):
    return brute_leaks(list(enumerate(texts)), list(enumerate(items)))


def test_leaks_of_every_alteration(spark):
    """Halves moved, words inserted and deleted, sentences doubled, cases changed: what all windows give, and nothing else."""
    r = random.Random(9)
    items = [" ".join(f"i{k}w{j}" for j in range(n)) for k, n in enumerate((15, 24, 40, 59, 120))] + ["go on go on go on go on go on go on", "tick tock " * 15]
    texts = []
    for item in items:
        w = item.split()
        for _ in range(6):
            v, lead = list(w), [f"f{r.random()}" for _ in range(r.choice([0, 3, 80]))]
            match r.randrange(6):
                case 0:
                    k = r.randrange(1, len(v))
                    v = v[k:] + v[:k]
                case 1:
                    for _ in range(r.randrange(1, 3)):
                        v.insert(r.randrange(len(v)), "new")
                case 2:
                    for _ in range(r.randrange(1, 3)):
                        del v[r.randrange(len(v))]
                case 3:
                    v = v[: len(v) // 2] + v[: len(v) // 2] + v[len(v) // 2 :]
                case 4:
                    v = [x.upper() for x in v]
                case 5:
                    v = v + ["mid"] * r.randrange(3) + v
            texts.append(" ".join(lead + v + lead[::-1]))
    rows = docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    known = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute_rows(texts, items)
    got = {(x.doc_id, x.item_id): x.similarity for x in decontam.leaks(rows, known).collect()}
    assert got.keys() == want.keys() and len(want) > 15
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_recall_on_a_table(spark):
    """All that a full scan finds is found."""
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute_leaks([tuple(r) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert got == want.keys() and got


def test_candidates_of_one_size(spark):
    """Of 200 items and as many windows of one size less than 5 % of all pairs pass the index, and all true ones."""
    r = random.Random(12)
    items = [[f"w{r.randrange(400)}" for _ in range(34)] for _ in range(200)]
    docs = spark.createDataFrame([(i, " ".join(["x", *w[:20], "new", *w[20:]])) for i, w in enumerate(items)], "doc_id long, text string")
    sought = decontam.rare_shingles(decontam.items(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")), 0.7).cache()
    bodies = decontam.suspects(docs, sought).select("d", "h").cache()
    asked = decontam.candidates(bodies, sought, 0.7).cache()
    windows = decontam.windows(bodies, sought, 0.7).count()
    assert windows >= 200 and 200 <= asked.count() < 0.05 * windows * 200 and asked.select("item").distinct().count() == 200


def test_the_index_finds_all_within_the_radius(spark):
    r = random.Random(6)
    rows, marks = [], []
    for k in range(60):
        fp = r.getrandbits(64)
        marks.append((k, 20, simhash.signed(fp)))
        for d in (0, 5, 16, 22, 23, 24, 30):
            rows.append((20, simhash.signed(fp ^ sum(1 << b for b in r.sample(range(64), d))), k, d))
    asked = spark.createDataFrame([x[:2] for x in rows] + [(21, x[1]) for x in rows], "size int, fp long")
    got = {(x.fp, x.item) for x in decontam.near(asked.distinct(), spark.createDataFrame(marks, "item long, size int, item_fp long")).collect()}
    assert {(fp, k) for _, fp, k, d in rows if d <= 23} == {(fp, k) for fp, k in got if (fp, k) in {(x[1], x[2]) for x in rows}}
    assert not {(x[1], x[2]) for x in rows if x[3] > 23} & got


def test_nothing_is_found_without_the_index(spark, monkeypatch):
    """Which items a window may be like is known from the index alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.leaks(docs, known).count() > 0
    monkeypatch.setattr(decontam, "near", lambda asked, known: asked.select("size", "fp", F.lit(0).cast("long").alias("item")).limit(0))
    assert decontam.leaks(docs, known).count() == 0


def test_fingerprints_slide(spark):
    """Differences of running sums give what each window's own shingles give."""
    r = random.Random(3)
    h = [r.getrandbits(64) - (1 << 63) for _ in range(60)]
    bodies = spark.createDataFrame([("a", h), ("b", h[::-1][:20])], "d string, h array<long>")
    found = spark.createDataFrame([("a", n, a, n) for n in (1, 7, 20) for a in range(0, 61 - n, 3)] + [("b", 30, 0, 20)], "d string, size int, start int, long int")
    for x in decontam.fingerprints(bodies, found).collect():
        mine = [v & (2**64 - 1) for v in (h if x.d == "a" else h[::-1][:20])[x.start : x.start + x.long]]
        assert x.fp & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in mine) > len(mine))


def test_long_items_take_little_longer(spark):
    """The work of a leaked item grows with its words, not with their square."""

    def seconds(n):
        item = " ".join(f"i{n}w{j}" for j in range(n))
        docs = spark.createDataFrame([(k, f"{'lead ' * k} {item} tail") for k in range(3)] + [(9, "other words here and there")], "doc_id long, text string")
        bench = spark.createDataFrame([(1, item), (2, "another item of some words that is nowhere " * 3)], "item_id long, text string")
        began = time.monotonic()
        got = {(x.doc_id, x.item_id): x.similarity for x in decontam.leaks(docs, bench).collect()}
        assert got == {(k, 1): 1.0 for k in range(3)}
        return time.monotonic() - began

    seconds(100)
    short = seconds(500)
    assert seconds(10_000) < 4 * short + 5


# --- token store


def test_stripes_indexes_and_filters(spark, tmp_path):
    """A lookup reads few of the rows: stripes, row groups and Bloom filters rule out the rest."""
    docs = spark.range(0, 60_000, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(k)), 256) for k in range(6)]).alias("text"))
    path = str(tmp_path / "tokens")
    token_store.write(docs, queries.tokenizer_path(), path, stripe_mb=1, row_index_stride=1000)
    files = [orc.ORCFile(f) for f in sorted(tmp_path.glob("tokens/*.orc"))]
    assert sum(f.nrows for f in files) == 30_000 and sum(f.nstripes for f in files) > len(files)
    assert sum(f.read_stripe(k).num_rows for f in files for k in range(f.nstripes)) == 30_000

    def scanned(where):
        df = token_store.read(spark, path).where(where).select("n_tokens", "doc_id")
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        text = plan.toString()
        leaf = plan
        while leaf.children().size():
            leaf = leaf.children().head()
        return len(rows), leaf.metrics().get("numOutputRows").get().value(), text

    n, read, plan = scanned("doc_id = 31000")
    assert n == 1 and 1 <= read <= 2000 and "EqualTo(doc_id,31000)" in plan
    assert scanned("doc_id = 31001")[:2] == (0, 0)  # between the ends of its row group, but not in its Bloom filter
    n, read, _ = scanned("doc_id between 2000 and 2100")
    assert n == 51 and read <= 3000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1mb")
    try:
        split = token_store.read(spark, path)
        assert split.rdd.getNumPartitions() > len(files) and split.count() == 30_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_start_is_the_place_in_the_files(spark, tmp_path):
    """Rows that share an id, or have none, start where the files have them."""
    rows = [(i, t, None, None) for i in (5, None) for t in ("a", "a b c", "a b", "a b c d e", None, "", "a")] + [(4, "x y", None, None), (6, "z", None, None)]
    docs = docs_of(spark, rows).withColumns({"row": F.lit(1), "start": F.lit(2), "tokens": F.lit("t")})
    path = str(tmp_path / "store")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.store(docs, queries.tokenizer_path(), path).collect())
    import zlib

    at, want = 0, []
    for f in sorted(tmp_path.glob("store/*.orc")):
        for r in orc.ORCFile(f).read().to_pylist():
            want.append((at, r["doc_id"], r["n_tokens"], zlib.crc32(np.array(r["tokens"], "<u4").tobytes())))
            at += len(r["tokens"])
    assert got == want and len(want) == len(rows)
    ids = [d for _, d, *_ in want]
    assert ids == [None] * 7 + [4] + [5] * 7 + [6]


def test_another_tokenizer_is_used_as_it_is():
    import public_tokenizers

    enc = token_store.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert enc.plain and not token_store.Encoder(queries.tokenizer_path()).plain
    texts = ["Two  words\n\nand a line", None, "", "Éa1"]
    ids, counts = enc.batch(texts)
    want = [[*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))


# --- personal data


@pytest.mark.parametrize("text,n", [("00000000000000000000001.2.3.4", 1), ("0000256.1.1.1", 0), ("1.2.3." + "0" * 5000 + "9", 1), ("1.2.3." + "9" * 5000, 0), ("000.000.000.000", 1)])
def test_addresses_with_leading_zeros(text, n):
    assert [k for *_, k in pii.find(text)].count("ip") == n


@pytest.mark.parametrize("part", ["@", "+1", "1.", "1 ", "a@a.", "http://", "account ", "iban ", "+1(((", "1-", "0.0.0.0."])
def test_texts_made_of_anchors(part):
    import time

    began = time.process_time()
    pii.find(part * 40_000)
    assert time.process_time() - began < 20


def test_span_rows_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, "a@b.c", "x", 1), (1, "a@b.c", "x", 1), (None, None, None, 2)], "doc_id long, text string, spans string, n_email int")
    got = sorted((r.n_email, r.spans) for r in pii.personal(rows).collect())
    assert got == [(0, ""), (1, "email:0:5"), (1, "email:0:5")] and pii.personal(rows.limit(0)).count() == 0
