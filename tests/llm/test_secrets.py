"""Guess costs of values of any length, words of the corpus, and the rows they decide."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import secrets
from tests.llm.test_operators import segment_cost


@pytest.mark.parametrize("seed", range(6))
def test_long_values_cost_what_all_segmentations_cost(seed):
    r = random.Random(seed)
    parts = ["a", "ab", "1", "Z", "-", "abc", "qwerty", "xyz", "987", "my", "Pass", "p4ss", "2019", "05", "token"]
    value = "".join(r.choice(parts) * r.randint(1, 6) for _ in range(12))[:150]
    best = [0.0]
    for end in range(1, len(value) + 1):
        best.append(min(best[a] + segment_cost(value[a:end]) for a in range(end)))
    assert secrets.guess_cost(value) == pytest.approx(best[-1])


@pytest.mark.parametrize("value", ["a" * 50_000, "ab" * 20_000, "0123456789" * 4_000, "qwertyuiop" * 3_000, "abcabcab" * 4_000 + "xyz" * 3_000])
def test_long_values_take_linear_time(value):
    began = time.process_time()
    assert secrets.guess_cost(value) < 30
    assert time.process_time() - began < 8


def test_long_values_are_told_by_cost():
    r = random.Random(3)
    noise = "".join(r.choice("abcdefghjkmnpqrstuvwxyz!?$%") for _ in range(400))
    for value, dear in (("x" * 500, False), ("xy7" * 90, False), ("2019" * 60, False), (noise, True)):
        assert ("guess" in {k for *_, k in secrets.search(f"pwd => {value}!")[0]}) == dear


def test_words_are_no_secrets():
    for text in ("token is available immediately", "auth: notification", "passphrase: correcthorsebatterystaple"):
        spans, cost = secrets.search(text)
        assert spans == [] and cost < secrets.DEAR
    for text in ("auth: kzq9!tWm#4xv", "pwd is hvq!zt.kwpx-uy"):
        assert [k for *_, k in secrets.search(text)[0]] == ["guess"]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('"password": "Zx9,kQ2vLpW7"', "Zx9,kQ2vLpW7"), ("password: Kx8(vQ2)pL9{z}", "Kx8(vQ2)pL9{z}"), ("pwd = 'q;9(kZ w!x2Lm8)'", "q;9(kZ w!x2Lm8)"), ("login(passphrase=Zx9kQ2!vLpW7)", "Zx9kQ2!vLpW7"), ('pwd: "k8#\\"vQ2)pL9"', '"k8#\\"vQ2)pL9"'[1:-1]),
        ("auth => https://user:Zx9kQ2vLpW7h@example.com/path", "https://user:Zx9kQ2vLpW7h@example.com/path"), ('{"pwd": "hvqztkwpxuy!7", "x": 1}', "hvqztkwpxuy!7"), ("pwd is kzqwxvptmn.bvcxzlkj", "kzqwxvptmn.bvcxzlkj"), ('pwd: "Zx9kQ2!vLpW7 unclosed', "Zx9kQ2!vLpW7"),
    ],
)
def test_values_are_whole(text, value):
    """Quoted values reach their quote, bare ones the bracket that they didn't open."""
    start = text.index(value)
    assert f"guess:{start}:{start + len(value)}" in [f"{k}:{a}:{b}" for a, b, k in secrets.search(text)[0]]


@pytest.mark.parametrize("text", ["token: https://example.com/docs/reference/index.html", "auth = sessionmanager.getinstance", "auth = SessionManager.getInstance()", '"secret": "The secret that you have been given by the administrator"', "pwd = os.environ.get", "token = request.headers.authorizationHeader", 'auth: ""', "auth: ()", "credentials := http://localhost:8080/login?next=start"])
def test_links_names_and_prose_are_no_secrets(text):
    assert [s for s in secrets.search(text)[0] if s[2] == "guess"] == []


@pytest.mark.parametrize("text", ["pwd: " + "(" * 50_000, 'pwd: "' + "\\" * 50_000, "pwd: '" * 20_000, "auth: " + "a." * 50_000, "pwd: http://" + "x/" * 30_000, 'pwd: "' + "ab " * 30_000 + '"'])
def test_odd_values_take_linear_time(text):
    began = time.process_time()
    secrets.search(text)
    assert time.process_time() - began < 8


def test_words_of_the_corpus(spark):
    """Frequent words of any language are known; values after credential words are not learned, nor are rare words."""
    prose = "der fahrscheinautomat steht neben der bahnhofshalle und die schaffnerin wartet"
    texts = [prose, f"Noch einmal {prose}", "auth: fahrscheinautomat", "pwd: bahnhofshalleschaffnerin", *["passcode: zkvwqjxhgf"] * 40, "seltenesdingwort", None, ""]
    docs = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, max_cost string")
    words = secrets.dictionary(docs)
    assert {"fahrscheinautomat", "bahnhofshalle", "schaffnerin"} <= words.keys() and not {"zkvwqjxhgf", "seltenesdingwort"} & words.keys()
    assert len(secrets.dictionary(docs, most=3)) <= 3
    got = {r.doc_id: r for r in secrets.secrets(docs).collect()}
    assert len(got) == len(texts)
    assert got[2].spans == "" and got[3].spans == "" and got[2].max_cost < got[3].max_cost < secrets.DEAR
    assert got[4].spans == "guess:10:20" and got[4].max_cost >= secrets.DEAR
    assert got[0].max_cost is None and got[len(texts) - 2].max_cost is None
    assert secrets.secrets(docs, {}).where(F.col("n_added") > 0).count() == 42


def test_cost_on_every_row_with_a_credential(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = secrets.secrets(docs).collect()
    assert sum(r.n_assign > 0 for r in rows) > 0 and all(r.max_cost is not None for r in rows if r.n_assign)
