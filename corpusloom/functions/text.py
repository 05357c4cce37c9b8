"""Column expressions over texts and paths: previews, search, types, sizes, ids."""

from __future__ import annotations

import re
from re import _parser
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import model
from corpusloom.errors import CorpusError
from corpusloom.functions.ambiguity import too_slow

#: A finding that starts with this asks for a check.
VERIFY = "NEEDS_VERIFICATION"


def peek(text: Column, start: int = 0, end: int | None = None) -> Column:
    """Characters start (from 0) up to end, at most 50,000."""
    n = model.PREVIEW_CHARS if end is None else max(0, min(end - start, model.PREVIEW_CHARS))
    return F.substring(text, start + 1, n)


def peek_head(text: Column, n: int = 3000) -> Column:
    return F.left(text, F.lit(min(n, model.PREVIEW_CHARS)))


def peek_tail(text: Column, n: int = 3000) -> Column:
    return F.right(text, F.lit(min(n, model.PREVIEW_CHARS)))


def truncate_output(text: Column, most: int = model.OUTPUT_CHARS, suffix: str = "... [truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(suffix))).otherwise(text)


def is_safe_regex(pattern: str) -> bool:
    r"""Whether a pattern compiles and its matching can't take exponential, or a high power of the text's, time.

    Refused are, read from the parsed pattern: a repeat inside a repeat (``(a+)+``, ``(.*){5}``, ``(abc){2,}`` over a
    counted group); repeated alternatives that can start with the same character (``(a|a)*``, ``(a|ab)+``); three or more
    open repeats in a row that share a character (``.*.*.*``, two if they are equal: ``\w+\w+``); counts of 1,000 or more.
    What these shapes let pass is judged by the ways through the pattern's automaton (``ambiguity``).
    """
    try:
        return not (_unsafe(_parser.parse(pattern), False) or _alike(pattern) or too_slow(pattern))
    except (re.error, OverflowError, RecursionError):
        return False


_REPEATS = {_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT}


def _unsafe(tree, repeated: bool) -> bool:
    before: list[tuple[frozenset, str]] = []
    for op, arg in tree:
        if op in _REPEATS:
            low, high, inner = arg
            if high != _parser.MAXREPEAT and high >= 1000 or low >= 1000:
                return True
            many = high == _parser.MAXREPEAT or high > 1
            if many and repeated and op != _parser.POSSESSIVE_REPEAT:
                return True
            group = any(o in (_parser.SUBPATTERN, _parser.ATOMIC_GROUP) for o, _ in inner)
            if many and group and (low, high) != (0, 1) and high != _parser.MAXREPEAT and _loose(inner):
                return True
            if many and group and high == _parser.MAXREPEAT and low >= 2:
                return True
            if _unsafe(inner, repeated or many):
                return True
            if high == _parser.MAXREPEAT:
                mine = (_starts(inner), str(inner))
                run = [s for s in before if s[0] & mine[0]]
                if len(run) >= 2 or any(s[1] == mine[1] for s in before):
                    return True
                before.append(mine)
                continue
        elif op == _parser.SUBPATTERN:
            if _unsafe(arg[-1], repeated):
                return True
        elif op in (_parser.ASSERT, _parser.ASSERT_NOT):
            if _unsafe(arg[1], repeated):
                return True
        elif op == _parser.ATOMIC_GROUP:
            if _unsafe(arg, False):
                return True
        elif op == _parser.BRANCH:
            firsts = [_starts(b) for b in arg[1]]
            if repeated and any(x & y for i, x in enumerate(firsts) for y in firsts[:i]):
                return True
            if any(_unsafe(b, repeated) for b in arg[1]):
                return True
        if op not in (_parser.AT, _parser.ASSERT, _parser.ASSERT_NOT):
            before = []
    return False


def _alike(pattern: str) -> bool:
    """Whether a repeated group has alternatives that can start alike (read from the text, since the parser joins such alternatives)."""
    opened: list[list[int]] = []
    skip, in_class = False, False
    for i, c in enumerate(pattern):
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif in_class:
            in_class = c != "]" or pattern[i - 1] == "["
        elif c == "[":
            in_class = True
        elif c == "(":
            opened.append([i])
        elif c == "|" and opened:
            opened[-1].append(i)
        elif c == ")" and opened:
            bars = opened.pop()
            if len(bars) > 1 and re.match(r"[*+]|\{\d*(,\d*)?\}", pattern[i + 1 :]) and not re.match(r"\{[01]?(,1)?\}", pattern[i + 1 :]):
                first = re.sub(r"^\((\?(:|P<\w+>|[a-zA-Z-]+:))?", "", pattern[bars[0] : bars[1]])
                parts = [first, *(pattern[a + 1 : b] for a, b in zip(bars[1:], [*bars[2:], i]))]
                firsts = [_starts(_parser.parse(x)) for x in parts]
                if not all(parts) or any(x & y for k, x in enumerate(firsts) for y in firsts[:k]):
                    return True
    return False


def _loose(tree) -> bool:
    """Whether a repeat without end is in the tree."""
    return any(
        op in _REPEATS and (arg[1] == _parser.MAXREPEAT or _loose(arg[2])) or op == _parser.SUBPATTERN and _loose(arg[-1]) or op == _parser.BRANCH and any(map(_loose, arg[1]))
        for op, arg in tree
    )


def _starts(tree) -> frozenset:
    """The characters below 128, and one for all others (128), that a match of the tree can start with; all where that is unknown."""
    every, out = frozenset(range(129)), frozenset()
    one = lambda c: frozenset({min(c, 128)})
    kinds = {"DIGIT": "0-9", "SPACE": r"\s", "WORD": r"\w"}
    for op, arg in tree:
        if op == _parser.LITERAL:
            return out | one(arg)
        if op == _parser.NOT_LITERAL:
            return out | every - one(arg) | {128}
        if op == _parser.IN:
            got, negated = frozenset(), False
            for kind, value in arg:
                if kind == _parser.NEGATE:
                    negated = True
                elif kind == _parser.LITERAL:
                    got |= one(value)
                elif kind == _parser.RANGE:
                    got |= frozenset(range(min(value[0], 128), min(value[1], 128) + 1))
                else:
                    name = str(value).removeprefix("CATEGORY_")
                    cls = re.compile("[" + kinds[name.removeprefix("NOT_")] + "]")
                    inside = frozenset(c for c in range(128) if cls.match(chr(c))) | {128}
                    got |= (every - inside | {128}) if name.startswith("NOT_") else inside
            return out | (every - got | {128} if negated else got)
        if op in _REPEATS:
            out |= _starts(arg[2])
            if arg[0]:
                return out
        elif op == _parser.SUBPATTERN:
            return out | _starts(arg[-1])
        elif op == _parser.BRANCH:
            return out.union(*map(_starts, arg[1]))
        elif op not in (_parser.AT, _parser.ASSERT, _parser.ASSERT_NOT):
            return every
    return out


@F.pandas_udf(T.BooleanType())
def safe_regex(patterns: pd.Series) -> pd.Series:
    """``is_safe_regex`` of patterns that come as rows."""
    return patterns.map(lambda p: p is not None and is_safe_regex(p))


def grep(text: Column, pattern: str, most: int = model.GREP_MATCHES) -> Column:
    """array<string> of the first matches; raises for unsafe patterns."""
    if not is_safe_regex(pattern):
        raise CorpusError("pattern", "the pattern may take very long", what="pattern")
    return F.slice(F.regexp_extract_all(text, F.lit(pattern), 0), 1, most)


def grep_spans(text: Column, pattern: str, window: int = model.GREP_WINDOW, most: int = model.GREP_MATCHES) -> Column:
    """array<struct<match, start, end, snippet>>: starts follow from the lengths of the pieces between matches."""
    found = grep(text, pattern, most)

    def spans(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(m))
        step = lambda done, pair: F.struct((done["at"] + F.length(pair["gap"]) + F.length(pair["m"])).alias("at"), pair["m"].alias("m"))
        pairs = F.zip_with(gaps, m, lambda gap, x: F.struct(gap.alias("gap"), x.alias("m")))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("m"))
        # One pass: the end of each match is the end before it, the gap and the match itself.
        ends = F.aggregate(pairs, F.array(start), lambda done, pair: F.concat(done, F.array(step(F.element_at(done, -1), pair))))

        def one(e: Column) -> Column:
            first, end = e["at"] - F.length(e["m"]), e["at"]
            left = F.greatest(F.lit(0), first - window)
            return F.struct(e["m"].alias("match"), first.alias("start"), end.alias("end"), F.substring(text, left + 1, end + window - left).alias("snippet"))

        return F.transform(F.slice(ends, 2, F.greatest(F.size(m), F.lit(0))), one)

    return F.transform(F.array(found), spans)[0]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def content_type(ext: Column) -> Column:
    kind = F.when(ext.isin(*model.CODE_EXTENSIONS), "code").when(ext.isin(*model.CONFIG_EXTENSIONS), "config")
    kind = kind.when(ext.isin(".md", ".rst", ".txt", ".html"), "docs").otherwise("other")
    return F.concat(kind, F.lit(":"), ext)


def chunk_size(ext: Column) -> Column:
    sizes = F.create_map(*[F.lit(x) for kv in model.CHUNK_SIZES.items() for x in kv])
    return F.coalesce(F.try_element_at(sizes, ext), F.lit(model.DEFAULT_CHUNK_SIZE))


def language(ext: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in model.LANGUAGES.items() for x in kv]), ext)


def normalize_path(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def count_tokens(text: Column) -> Column:
    """About four characters a token."""
    return F.ceil(F.length(text) / 4).cast("long")


def chunk_id(path: Column, start_line: Column, content: Column, digits: int = 16) -> Column:
    """64 bits by default, so that ids of different chunks don't meet; ``short_id`` is for reading."""
    return F.left(F.sha2(F.concat_ws("|", path, start_line.cast("string"), content), 256), F.lit(digits))


def short_id(chunk: Column) -> Column:
    """The first 8 digits of a chunk's id, for listings; not a key."""
    return F.left(chunk, F.lit(8))


def line_number(text: Column, offset: Column) -> Column:
    """1-based line of a character offset."""
    head = F.left(text, offset)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def format_size(size: Column) -> Column:
    kb = size / 1024
    fixed = lambda x, unit: F.concat(F.format_string("%.1f", F.bround(x.cast("double"), 1)), F.lit(unit))
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1 << 20, fixed(kb, " KB"))
        .when(size < 1 << 30, fixed(kb / 1024, " MB"))
        .otherwise(fixed(kb / (1 << 20), " GB"))
    )


def negation(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("no ") | low.contains("not ") | low.contains("never ") | low.contains("without ") | low.contains("n't ")


def lower_words(text: Column) -> Column:
    """Lower-case words in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r]+"), "")


def tokens(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(lower_words(text))


def block_tokens(text: Column, n: int = 5, least: int = 3) -> Column:
    """The first five words of three characters or more."""
    return start_tokens(lower_words(text), n, least)


def start_tokens(words: Column, n: int = 5, least: int = 3) -> Column:
    """``block_tokens`` of a text's ``lower_words``."""
    return F.array_distinct(F.slice(F.filter(words, lambda w: F.length(w) >= least), 1, n))


def relevance(text: Column, query: str) -> Column:
    """How many distinct words of the query the text has."""
    words = sorted(set(query.lower().split()))
    return F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, words)))).cast("long")


def confidence_score(c: Column) -> Column:
    return F.when(F.lower(c) == "high", 3).when(F.lower(c) == "medium", 2).otherwise(1)


def needs_verification(point: Column) -> Column:
    """Whether a finding asks to be checked."""
    return F.coalesce(point.startswith(VERIFY), F.lit(False))


def without_flag(point: Column) -> Column:
    """The finding's text without the request to check it."""
    return F.regexp_replace(point, f"^{VERIFY}:?[ ]*", "")


def can_be_similar(a: Column, b: Column, ratio: float = 0.5) -> Column:
    """Lengths within ``ratio`` of each other and a word in common."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (short >= long * ratio) & F.arrays_overlap(tokens(a), tokens(b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 if neither text has a word."""
    both = F.size(F.array_intersect(tokens(a), tokens(b)))
    every = F.size(F.array_union(tokens(a), tokens(b)))
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Characters in matching blocks, twice, over all characters; the smaller text first, so that order has no effect."""
    return pd.Series([SequenceMatcher(None, *sorted((x or "", y or "")), autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def chunking_timeout(n_bytes: Column) -> Column:
    """Seconds to allow for cutting a file: two a megabyte, from 30 to 120."""
    return F.greatest(F.lit(30.0), F.least(n_bytes / (1 << 20) * 2, F.lit(120.0)))


def content_hash(text: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of a text: sha256, xxh64 (seed 42) or xxh3 (64 bits, seed 0); null for null."""
    if algorithm == "xxh64":
        return F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0"))
    if algorithm == "xxh3":
        return _xxh3(text)
    if algorithm != "sha256":
        raise CorpusError("setting", f"{algorithm} is not sha256, xxh64 or xxh3", what="algorithm")
    return F.sha2(text, 256)


@F.pandas_udf(T.StringType())
def _xxh3(texts: pd.Series) -> pd.Series:
    from xxhash import xxh3_64_hexdigest

    return texts.map(lambda t: None if t is None else xxh3_64_hexdigest(t.encode()))


#: Look-alikes of angle brackets and the solidus, and what they become; invisible characters go.
LOOK_ALIKES = ("\uff1c\u2039\u27e8\u3008\ufe64\uff1e\u203a\u27e9\u3009\ufe65\uff0f\u2044\u2215", "<<<<<>>>>>///")
INVISIBLE = "[\u200b-\u200f\u2060-\u2064\ufeff\u00ad]"


def sanitize_xml(text: Column) -> Column:
    """Comment and CDATA ends and the prompt's own tags lose their angle brackets, also where look-alikes or invisible characters spell them."""
    tags = "system|query|position|content|instructions|response|format"
    odd = f"[{LOOK_ALIKES[0]}]"
    plain = F.translate(F.regexp_replace(text, INVISIBLE, ""), *LOOK_ALIKES)
    spelled = F.when(text.rlike(f"{odd}|{INVISIBLE}") & plain.rlike(f"(?i)</?\\s*({tags})\\b[^<>]*>|<!--|-->|\\]\\]>"), plain).otherwise(text)
    out = F.regexp_replace(spelled, "<!--|-->|\\]\\]>", "")
    return F.regexp_replace(out, f"(?i)<(/?)\\s*({tags})\\b[^<>]*>", "[$1$2]")


def valid_session(name: Column) -> Column:
    return name.rlike(r"\A[a-zA-Z0-9_-]+\z")


def failure_type(message: Column) -> Column:
    """What kind of failure a message tells of; very short answers count as low quality."""
    m, n = F.lower(message), F.length(message)
    return (
        F.when(n == 0, "unknown").when(m.rlike("time[d -]*out"), "timeout").when(m.rlike("rate.?limit|429"), "rate_limit")
        .when(m.rlike("pars|json"), "parse_error").when(m.rlike("complex|too large"), "complexity").when(n < 50, "quality_low").otherwise("unknown")
    )


def glob_to_regex(glob: str) -> str:
    """A shell pattern (``*``, ``?``, ``[..]``, ``[!..]``) as a regular expression for a whole path component or path."""
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        close = glob.find("]", i + 1 + (glob[i : i + 1] == "!")) if c == "[" else -1
        if c in "*?":
            out += ".*" if c == "*" else "."
        elif close > 0:
            body = re.sub(r"([\\\[\]^&])", r"\\\1", glob[i + (glob[i] == "!") : close])
            out, i = f"{out}[{'^' if glob[i] == '!' else ''}{body}]", close + 1
        else:
            out += re.escape(c)
    return rf"\A(?s:{out})\z"
