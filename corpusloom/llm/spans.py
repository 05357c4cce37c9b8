"""Rows of spans found by a function of one text; shared by the secret and the personal-data scans."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (start, end, kind): code points, end exclusive.
Span = tuple[int, int, str]


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, find: Callable[[str], list[Span] | tuple[list[Span], float | None]], base: tuple[str, ...], added: tuple[str, ...], measure: str | None = None) -> DataFrame:
    """(doc_id, n_<kind> for each base kind, base_sha256, spans, n_added), a row for each row of ``docs``.

    Spans are ordered by start, then by kind in the order of ``base + added``. With ``measure`` the
    function gives (spans, number or none), and the number is a further column of that name.
    """
    rank = {k: i for i, k in enumerate(base + added)}
    names = [f"n_{k}" for k in base]
    none = hashlib.sha256(b"").hexdigest()

    def row(text: str | None) -> tuple:
        got = find(text or "")
        spans, more = (got[0], (got[1],)) if measure else (got, ())
        if not spans:
            return (*[0] * len(base), none, "", 0, *more)
        spans = sorted(spans, key=lambda s: (s[0], rank[s[2]], s[1]))
        mine = [s for s in spans if s[2] in names_of_base]
        counts = [sum(s[2] == k for s in mine) for k in base]
        return (*counts, hashlib.sha256(written(mine).encode()).hexdigest(), written(spans), len(spans) - len(mine), *more)

    names_of_base = set(base)
    columns = [*names, "base_sha256", "spans", "n_added", *([measure] if measure else [])]
    kinds = [*[f"{n} long" for n in names], "base_sha256 string", "spans string", "n_added long", *([f"{measure} double"] if measure else [])]

    @F.pandas_udf(", ".join(kinds))
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([row(t) for t in texts], columns=columns)

    return docs.select("doc_id", found("text").alias("f")).select("doc_id", *[f"f.{c}" for c in columns])
