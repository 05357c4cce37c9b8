"""The map step: rule packs over chunks, analyser responses, markers and prompts."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import model
from corpusloom.errors import CorpusError
from corpusloom.functions.text import sanitize_xml
from corpusloom.plans.running import running_sum


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    confidence: str
    point: str


# Patterns that Java's and RE2's engines read alike.
RULES = (
    Rule("license", "Licensed under the [A-Za-z]+", "high", "license text in file"),
    Rule("secret", 'token = "[0-9a-f]+"', "high", "token assigned in file"),
    Rule("email", "[A-Za-z0-9.]+@[A-Za-z0-9]+[.][A-Za-z0-9.]+[A-Za-z]", "medium", "mail address in file"),
    Rule("address", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "low", "network address in file"),
    Rule("digits", "[0-9]{13,19}", "low", "long number in file"),
)


def findings(chunks: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", by: str = "path") -> DataFrame:
    """(by, rule, point, evidence, confidence): one row per match of a rule, all rules in one pass."""

    def pack(r: Rule) -> Column:
        tagged = lambda e: F.struct(F.lit(r.name).alias("rule"), F.lit(r.point).alias("point"), e.alias("evidence"), F.lit(r.confidence).alias("confidence"))
        return F.transform(F.regexp_extract_all(text, F.lit(r.pattern), 0), tagged)

    packs = [pack(r) for r in rules]
    return chunks.select(by, F.explode(F.concat(*packs)).alias("f")).select(by, "f.*")


def placeholders(chunks: DataFrame) -> DataFrame:
    """Results of chunks that no analyser has seen."""
    return chunks.select("chunk_id", F.lit("placeholder").alias("status"), F.array().cast(T.ArrayType(model.FINDING)).alias("findings"))


def parse_response(response: Column) -> Column:
    """An analyser's answer as a chunk result: JSON in a fence, or bare; null if it can't be read."""
    fenced = F.regexp_extract(response, r"```(?:json)?\s*(\{[\s\S]*?\})\s*```", 1)
    return F.from_json(F.when(F.length(fenced) > 0, fenced).otherwise(F.trim(response)), model.CHUNK_RESULT, {"mode": "PERMISSIVE"})


def has_marker(text: Column) -> Column:
    return text.rlike(r"(^|[^A-Za-z0-9_])(FINAL_VAR|FINAL|NEEDS_MORE|UNABLE)\(")


def markers(text: Column) -> Column:
    """array<struct<marker_type, content>> of markers whose content has no parentheses."""
    whole = F.regexp_extract_all(text, F.lit(r"(?:FINAL_VAR|FINAL|NEEDS_MORE|UNABLE)\([^()]*\)"), 0)
    return F.transform(whole, lambda w: F.struct(F.substring_index(w, "(", 1).alias("marker_type"), F.regexp_extract(w, r"\(([^()]*)\)", 1).alias("content")))


FOCUS = {
    "general": "Report what answers the query.",
    "security": "Report secrets, injections, unsafe calls and missing checks.",
    "architecture": "Report modules, dependencies and broken layering.",
    "performance": "Report repeated work, large copies and slow loops.",
}


DUTIES = "Use this chunk only. Quote evidence word for word. Say what is missing."
FORMAT = "One JSON object: chunk_id, status, findings (point, evidence, confidence, location), missing_info, suggested_queries, partial_answer."


def prompt(content: Column, query: str, no: Column, of: Column, agent: str = "general") -> Column:
    """The text an analyser is given for one chunk, in six sections; neither content nor query can close them."""
    if agent not in FOCUS:
        raise CorpusError("setting", f"{agent} is no kind of analyser", what="agent")
    if not query.strip():
        raise CorpusError("query", "a prompt needs a query", what="query")
    place = F.concat(no.cast("string"), F.lit(" of "), of.cast("string"))
    sections = {"system": F.lit(FOCUS[agent]), "query": sanitize_xml(F.lit(query)), "position": place, "instructions": F.lit(DUTIES), "content": sanitize_xml(content), "format": F.lit(FORMAT)}
    return F.concat_ws("\n", *[F.concat(F.lit(f"<{name}>"), F.coalesce(text, F.lit("")), F.lit(f"</{name}>")) for name, text in sections.items()])


def sequential_prompt(content: Column, query: str, no: Column, of: Column) -> Column:
    """The short form of the prompt, with the chunk between two boundaries."""
    head = F.concat(F.lit("--- chunk "), no.cast("string"), F.lit(" of "), of.cast("string"), F.lit(": "), sanitize_xml(F.lit(query)), F.lit(" ---\n"))
    return F.concat(head, sanitize_xml(content), F.lit("\n--- end of chunk ---"))


def agent_types(spark: SparkSession) -> DataFrame:
    """(agent_type, instructions)."""
    return spark.createDataFrame(list(FOCUS.items()), "agent_type string, instructions string")


def numbered_batches(chunks: DataFrame, order: list[Column], size: int = 5) -> DataFrame:
    """``chunks`` with their place ``no`` from 1 and the ``batch`` they fall into."""
    numbered = running_sum(chunks, F.lit(1), order, "no")
    return numbered.withColumn("batch", (F.floor((F.col("no") - 1) / size) + 1).cast("long"))


def page(chunks: DataFrame, order: list[Column], batch: int, limit: int = 5) -> DataFrame:
    """The chunks of one batch, counted from 1."""
    return chunks.orderBy(*order).offset((batch - 1) * limit).limit(limit)


def map_instructions(chunks: DataFrame, query: str, batch: int = 1, limit: int = 5, failed_only: bool = False, agent: str = "general") -> DataFrame:
    """(chunk_id, prompt) for a page of pending chunks (chunk_id, no, content, status), or of failed ones."""
    wanted = chunks.where(F.col("status") == ("failed" if failed_only else "pending"))
    shown = page(wanted, [F.col("no")], batch, limit)
    return shown.select("chunk_id", prompt(F.col("content"), query, F.col("no"), F.lit(chunks.count()), agent).alias("prompt"))


def run_map(chunks: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "content") -> DataFrame:
    """(chunk_id, status, findings): every chunk's result in one pass; a chunk without text fails."""

    def pack(r: Rule) -> Column:
        found = lambda e: F.struct(F.lit(r.name).alias("rule"), F.lit(r.point).alias("point"), e.alias("evidence"), F.lit(r.confidence).alias("confidence"))
        return F.transform(F.regexp_extract_all(text, F.lit(r.pattern), 0), found)

    status = F.when(F.col(text).isNull(), "failed").otherwise("success")
    return chunks.select("chunk_id", status.alias("status"), F.concat(*map(pack, rules)).alias("findings"))


OPENS = re.compile(r"(?<![A-Za-z0-9_])(FINAL_VAR|FINAL|NEEDS_MORE|UNABLE)\(")


def scan_markers(text: str) -> list[tuple[str, str, int]]:
    """(type, content, offset) of every marker; parentheses nest, but not inside double quotes. One never closed is none."""
    out, at = [], 0
    while m := OPENS.search(text, at):
        depth, quoted, i = 1, False, m.end()
        while i < len(text) and depth:
            c = text[i]
            if c == "\\" and quoted:
                i += 1
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c == "(") - (c == ")")
            i += 1
        if depth:
            at = m.end()
            continue
        out.append((m[1], text[m.end() : i - 1].strip(), m.start()))
        at = i
    return out


MARKERS_FOUND = T.ArrayType(T.StructType([T.StructField("marker_type", T.StringType()), T.StructField("content", T.StringType()), T.StructField("offset", T.IntegerType())]))


@F.pandas_udf(MARKERS_FOUND)
def nested_markers(texts: pd.Series) -> pd.Series:
    """Markers whose content may hold parentheses and JSON."""
    return texts.map(lambda t: [dict(zip(("marker_type", "content", "offset"), m)) for m in scan_markers(t or "")])


def final_answer(text: Column, values: Column) -> Column:
    """struct<kind, value> of the first FINAL or FINAL_VAR; a variable is looked up in the map ``values``.

    Kinds: final, final_var, final_var_error (no such variable), none.
    """
    ends = F.filter(nested_markers(text), lambda m: m["marker_type"].isin("FINAL", "FINAL_VAR"))

    def answer(m: Column) -> Column:
        name = F.regexp_replace(m["content"], "^[\"']|[\"']$", "")
        held = F.try_element_at(values, name)
        plain = F.struct(F.lit("final").alias("kind"), m["content"].alias("value"))
        known = F.struct(F.lit("final_var").alias("kind"), held.alias("value"))
        lost = F.struct(F.lit("final_var_error").alias("kind"), F.concat(F.lit("no variable "), name).alias("value"))
        return F.when(m["marker_type"] == "FINAL", plain).when(held.isNotNull(), known).otherwise(lost)

    none = F.struct(F.lit("none").alias("kind"), F.lit(None).cast("string").alias("value"))
    return F.coalesce(F.try_element_at(F.transform(ends, answer), F.lit(1)), none)
