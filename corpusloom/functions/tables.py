"""Search and chunking as table functions and views for SQL users."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from corpusloom import model
from corpusloom.errors import CorpusError
from corpusloom.functions.text import is_safe_regex


@udtf(returnType="match string, start int, end int, snippet string")
class Grep:
    """grep_text(text, pattern): the first matches of a text with their offsets and what is around them."""

    def eval(self, text: str, pattern: str) -> Iterator[tuple]:
        if not is_safe_regex(pattern):
            raise CorpusError("pattern", "the pattern may take very long", what="pattern")
        for n, m in enumerate(re.finditer(pattern, text or "")):
            if n == model.GREP_MATCHES:
                return
            a, b = m.span()
            yield m[0], a, b, text[max(0, a - model.GREP_WINDOW) : b + model.GREP_WINDOW]


@udtf(returnType="no int, start int, end int, content string")
class Chunks:
    """chunk_text(text, size, overlap): the chunks of a text."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        if size <= 0 or not 0 <= overlap < size:
            raise CorpusError("overlap", f"{overlap} does not fit a size of {size}", what="overlap")
        n = len(text or "")
        for no, a in enumerate(range(0, max(n - overlap, 1) if n else 0, size - overlap)):
            yield no, a, min(a + size, n), text[a : a + size]


def register(spark: SparkSession, **views: DataFrame) -> None:
    """The table functions, and ``views`` by name, for ``spark.sql``."""
    spark.udtf.register("grep_text", Grep)
    spark.udtf.register("chunk_text", Chunks)
    for name, rows in views.items():
        rows.createOrReplaceTempView(name)
