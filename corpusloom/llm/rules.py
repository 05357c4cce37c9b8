"""Quality rules as a short-circuit cascade of DataFrame expressions.

Base measures of a text: words, code points in words, symbols, repeated lines,
and words inside 8-word windows that occur twice or more. The base rules reject
short texts and texts of repeated windows. What they keep goes through a cascade
of further rules (``rules``); a text is rejected by the first rule it fails, and the
rules after it aren't evaluated. The order is set on a sample: every rule's
selectivity is the share it rejects, its cost the work it would do there, counted as
what it reads (characters, words, or the text's measures only) times ``WORK`` a unit,
and rules run by rejections per cost, best first. Counts rather than clocks, so that
the same table always gives the same order. The verdict is the conjunction of all
rules, so it doesn't depend on the order.

Repeated windows stay within their row: the windows' hashes are an array, and
only texts whose hashes aren't all distinct are sorted by (hash, place) to find
the places that repeat. No window is shuffled.

Cases. Null or empty text: zeros, ``base_failed`` (under 20 words), not kept.
Under 8 words: no window. Repeated rows are judged each, but count once in the
sample. Rules of equal worth run in their stated order. Very long texts are read
whole. An empty sample keeps the rules in their stated order; an empty table gives an
empty one. Other columns pass through in ``keep_passing``, but for those named
``__words``, ``__lines`` and ``__m``, which are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.errors import CorpusError
from corpusloom.llm.common import drawn, words_of

LEAST_WORDS = 20
WINDOW = 8
SAMPLE_ROWS = 2000


#: Work of a rule: what it reads in a text, and how much a unit of that costs beside a comparison (measured once, in
#: character steps of a plain pattern).
WORK = {
    "symbols": ("text", 1.0), "mean_word_length": ("text", 1.0), "repeated_lines": ("text", 1.0), "shouting": ("characters", 1.0), "letters": ("characters", 2.5),
    "capitals": ("characters", 3.5), "few_distinct_words": ("words", 10.0), "adjacent_repeats": ("characters", 3.5),
}


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words inside windows of 8 that occur twice or more in the array, first occurrences included."""

    def counted(h: Column) -> Column:
        starts = F.slice(h, 1, F.size(h) - (WINDOW - 1))
        windows = F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
        return F.when(F.size(h) > WINDOW, _bound(windows, _covered)).otherwise(F.lit(0)).cast("long")

    return _bound(F.transform(words, lambda w: F.xxhash64(w)), counted)


def _covered(h: Column) -> Column:
    """Words in the windows, of these hashes in order, that occur twice or more."""
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), _bound(_bound(placed, _repeats), _cover)).otherwise(0)


def _repeats(s: Column) -> Column:
    """The places, in order, of windows beside an equal one in the sorted array."""
    last = F.size(s) - 1
    twin = lambda i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == s[i]["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == s[i]["h"]))
    return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda i: s[i]["p"]))


def _cover(p: Column) -> Column:
    gaps = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.least(F.lit(WINDOW), p[i] - p[i - 1]))
    return F.aggregate(gaps, F.lit(WINDOW), lambda a, g: a + g)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__words``, ``__lines`` and the struct ``__m`` of base measures."""
    if taken := {"__words", "__lines", "__m"} & {c.lower() for c in docs.columns}:
        raise CorpusError("columns", f"{sorted(taken)} are names of the measures", what="docs")
    t = F.coalesce(F.col(text), F.lit(""))
    cut = docs.withColumn("__words", words_of(F.col(text))).withColumn("__lines", F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    w = F.col("__words")
    counted = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
    )
    return cut.withColumn("__m", counted)


def base_failed() -> Column:
    m = F.col("__m")
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def rules() -> dict[str, Column]:
    """name -> whether a text fails. Over the columns of ``measured``."""
    m, words, lines, text = F.col("__m"), F.col("__words"), F.col("__lines"), F.coalesce(F.col("text"), F.lit(""))
    return {
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "mean_word_length": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]),
        "repeated_lines": 100 * m["n_dup_lines"] > 40 * F.size(lines),
        "shouting": F.regexp_count(text, F.lit("[!?]{2}")) * 5 > m["n_words"],
        "letters": F.length(F.regexp_replace(text, r"[^\p{L}]", "")) * 2 < m["word_chars"],
        "capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) * 2 > m["word_chars"],
        "few_distinct_words": F.size(F.array_distinct(words)) * 6 < F.least(m["n_words"], F.lit(3000)),
        "adjacent_repeats": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D])")) * 5 > m["n_words"],
    }


def order_rules(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per cost, counted in one pass over about ``sample_rows`` different rows chosen by a hash of id and text."""
    names = rules()
    share = min(1.0, sample_rows / max(docs.count(), 1))
    place = F.xxhash64(F.col("doc_id"), F.xxhash64("text"))
    rows = docs.select(place.alias("h"), "text").where(drawn(F.col("h"), F.lit(share))).dropDuplicates(["h"])
    rows = measured(rows).where(~base_failed())
    reads = {"text": F.lit(1), "characters": F.length("text"), "words": F.col("__m.n_words")}
    counts = [F.coalesce(F.sum(reads[kind] * unit), F.lit(0.0)).alias(f"work_{name}") for name, (kind, unit) in WORK.items()]
    seen = rows.agg(F.count("*").alias("n"), *[F.count_if(fails).alias(name) for name, fails in names.items()], *counts).first()
    worth = {name: -((seen[name] + 1) / (seen["n"] + 1)) / max(seen[f"work_{name}"], 1.0) for name in names}
    return sorted(names, key=worth.get)


def verdict(order: list[str]) -> Column:
    """True if no rule fails, asked in ``order`` and only until one does."""
    every, cascade = rules(), None
    for name in order:
        cascade = F.when(every[name], False) if cascade is None else cascade.when(every[name], False)
    return cascade.otherwise(True)


def judge(docs: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    kept = F.when(base_failed(), False).otherwise(verdict(order))
    rows = measured(docs.select("doc_id", "text"))
    return rows.select("doc_id", "__m.*", base_failed().alias("base_failed"), kept.alias("kept"))


def keep_passing(docs: DataFrame, order: list[str]) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with the columns of ``docs``."""
    return measured(docs).where(F.when(base_failed(), False).otherwise(verdict(order))).select(*[F.col(f"`{c}`") for c in docs.columns])
