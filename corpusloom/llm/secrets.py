"""Secrets: fixed patterns, and values in a credential context that cost many guesses.

Base kinds are ``assign``, ``access`` and ``hex`` (see PATTERNS). The method adds
``guess``: the value after a credential word and a separator, if the cheapest
way to guess it is dear enough. The cost is the minimum over all segmentations
into known words, dates, repeats, keyboard walks and brute-force spans; logs of
guesses add up over the segments (dynamic programming over the value's
positions, values of any length). Values that cost little are words and placeholders, not
secrets.

Words. Known are common words of passwords and settings (WORDS) and the frequent words of
the corpus itself, whatever its languages: those that are one in ``most`` or more of all
words met, a text counting each once, and values after credential words none. There are
``most`` of them at the most; they are ranked by frequency and broadcast.

Values. A quoted value reaches its closing quote, whatever is in it; a bare one ends at white space, quotes, angle brackets, commas,
semicolons and brackets that it didn't open. A value is judged whole, but for what is made of parts: of a text with spaces,
a link or a dotted identifier the dearest part decides, and a part of plausible letters (NAME) counts as one rare word.

Cases. Null or empty text: no spans, no cost. Matches that fail a length are dropped
without another try inside them. Added spans that overlap a base span are left
out. A cost at the limit is dear. Spans that start together stand in the order of the kinds.
Repeated rows are scanned each; an empty table gives an empty one. Texts are scanned
whole; substring tests only decide which patterns need a run. Of the input only doc_id and
text are read, whatever other columns there are.
"""

from __future__ import annotations

import re
from math import log10

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.spans import Span, scan
from corpusloom.plans.staging import drop, stage

BASE = ("assign", "access", "hex")
ADDED = ("guess",)

ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CUES = ("passw", "secret", "token", "api")

CONTEXT = re.compile(
    r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?|bearer)"
    r"[\"']?(?:\x20*(?::=|=>|[:=])\x20*(?i:bearer\x20+|basic\x20+)?|\x20+(?i:is)\x20+)(?:\"([^\"\n\\]*(?:\\.[^\"\n\\]*)*)\"|'([^'\n\\]*(?:\\.[^'\n\\]*)*)'|[\"']?([^\s\"'<>,;]+))",
    re.ASCII,
)
#: The same for texts in lower case, as Java reads it.
CONTEXT_JVM = CONTEXT.pattern.replace("(?i:", "(?:")
CONTEXT_CUES = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
DEAR = 9.0
#: Bound on the corpus words that are known, and their longest.
MOST_WORDS = 200_000
LONGEST_WORD = 24

HEX_BYTES = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

# Common words of passwords, then of settings and of what is said about them.
WORDS = (
    "password", "qwerty", "letmein", "dragon", "monkey", "football", "baseball", "master", "welcome", "login",
    "admin", "princess", "sunshine", "shadow", "iloveyou", "correct", "horse", "battery", "staple", "secret", "changeme", "change", "default", "example",
    "test", "guest", "root", "user", "token", "access", "private", "public", "key", "api", "auth", "your", "here",
    "insert", "replace", "dummy", "sample", "placeholder", "none", "null", "undefined", "true", "false", "hello",
    "world", "love", "summer", "winter", "spring", "autumn", "monday", "friday", "server", "database", "system",
    "temp", "demo", "my", "the", "is", "this", "me", "pass", "word", "value", "string", "name", "id", "env", "get",
    "config", "process", "os", "environ", "self", "settings", "required", "optional", "redacted",
    "available", "notification", "immediately", "enabled", "disabled", "expired", "invalid", "valid", "missing", "empty", "unknown", "hidden", "allowed", "denied", "failed", "given",
    "needed", "stored", "used", "sent", "set", "not", "now", "only", "always", "never", "unset", "encrypted", "hashed", "generated", "random", "unique", "different", "correctly",
    "incorrect", "wrong", "right", "reset", "recovery", "manager", "management", "policy", "protected", "protection", "provider", "service", "session", "account", "basic", "bearer",
    "authentication", "authorization", "authorized", "certificate", "configuration", "connection", "credential", "credentials", "documentation", "development", "environment",
    "function", "header", "important", "information", "message", "method", "number", "object", "option", "parameter", "production", "question", "response", "request", "security",
    "something", "strength", "variable", "version", "with", "from", "that", "and", "for", "are", "was", "has", "can", "must", "should", "will", "please", "enter", "new", "old",
)
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
LEET = str.maketrans("@4301!5$7", "aaeoiisst")

# Rows of a keyboard; neighbours in a row, either way, make a walk.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT = {a + b for row in ROWS for s in (row, row[::-1]) for a, b in zip(s, s[1:])}
KEYS = sum(map(len, ROWS))

DATE = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d"
)


def _alphabet(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isalpha():
        return log10(26) if c.isascii() else 2.0
    return log10(33)


def _word_cost(part: str, lower: str, plain: str, ranks: dict[str, int]) -> float | None:
    """The cost of a known word, with its case and look-alike digits; none for other parts."""
    rank = ranks.get(lower) or ranks.get(plain)
    if not rank:
        return None
    cased = 0 if part == lower else log10(2) if part in (part.upper(), part.capitalize()) else len(part) * log10(2)
    return log10(rank + 1) + cased + (0 if lower in ranks else log10(4))


class _Open:
    """Starts of a segment whose cost is that at its start, ``unit``, and the log of its number of steps.

    Each step costs a later start more than an earlier one, so a start that is no cheaper than an earlier one
    now never will be and is dropped: few are open at a time.
    """

    def __init__(self):
        self.starts: list[tuple[int, float]] = []

    def least(self, end: int, unit: float, size: int = 1) -> float:
        low, kept = float("inf"), []
        for start, cost in self.starts:
            now = cost + log10((end - start) / size)
            if now < low:
                low = now
                kept.append((start, cost))
        self.starts = kept
        return low + unit


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses of the cheapest segmentation of a value, in time that grows with its length."""
    lower = value.lower()
    if len(lower) != len(value):
        lower = value
    plain = lower.translate(LEET)
    single = [_alphabet(c) for c in value]
    best = [0.0]
    walk, keys = _Open(), log10(KEYS)
    repeats = {unit: [_Open() for _ in range(unit)] for unit in range(1, 9)}
    run_from = dict.fromkeys(repeats, 0)
    for end in range(1, len(value) + 1):
        cost = best[-1] + single[end - 1]
        for start in range(max(0, end - LONGEST_WORD), end - 1):
            word = _word_cost(value[start:end], lower[start:end], plain[start:end], ranks)
            if word is not None:
                cost = min(cost, best[start] + word)
        if value[end - 1] in "0123456789":
            for start in range(max(0, end - 10), end - 3):
                if DATE.fullmatch(value, start, end):
                    cost = min(cost, best[start] + log10(36_500 if end - start > 4 else 120))
        # Walks of three keys or more, repeats of a unit of up to 8 characters, of three characters or more.
        if end > 1 and lower[end - 2 : end] in NEXT:
            if end > 2 and lower[end - 3 : end - 1] in NEXT:
                walk.starts.append((end - 3, best[end - 3]))
                cost = min(cost, walk.least(end, keys))
        else:
            walk = _Open()
        for unit, opened in repeats.items():
            if end <= unit:
                break
            if value[end - 1] != value[end - 1 - unit]:
                repeats[unit] = [_Open() for _ in range(unit)]
                run_from[unit] = end - unit
                continue
            mine, start = opened[end % unit], end - max(2 * unit, 3)
            once = sum(single[end - unit : end])
            if start >= run_from[unit]:
                opened[start % unit].starts.append((start, best[start]))
            cost = min(cost, mine.least(end, once, unit))
        best.append(cost)
    return best[-1]


#: Separators of the parts of a link; an identifier with dots; letters that can be a name: no five consonants in a row, a vowel in five letters.
LINK = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")
LINK_PARTS = re.compile(r"[/?&=#.:@_~+;,%-]+")
DOTTED = re.compile(r"\$?[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+(?:\(\w*\))?")
HUMPS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}")
CLOSED = {")": "(", "]": "[", "}": "{"}


def is_name(word: str) -> bool:
    low = word.lower()
    return low.isalpha() and low.isascii() and 5 * sum(c in "aeiouy" for c in low) >= len(low) and not CONSONANTS.search(low)


def part_cost(part: str, ranks: dict[str, int]) -> float:
    """The cost of a part of a link or identifier: the dearest of its words, a plausible one at most that of the rarest word known."""
    return max((min(guess_cost(w, ranks), log10(MOST_WORDS)) if is_name(w) else guess_cost(w, ranks) for w in _words(part)), default=0.0)


def _words(part: str) -> list[str]:
    """The words of a part in mixed case or with underscores, if these are all that it is; else the part itself."""
    words = [w for piece in part.split("_") for w in HUMPS.findall(piece)]
    return words if all(is_name(w) or len(w) < 5 and w.isdigit() for w in words) else [part]


def value_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """The cost of a value as a whole, or of its dearest part where it is prose, a link or a dotted identifier."""
    if any(c.isspace() for c in value):
        words = [v.strip(".,:;!?()[]{}") for v in value.split()]
        return max((part_cost(v, ranks) if v.isalpha() else value_cost(v, ranks) for v in words), default=0.0)
    if LINK.match(value):
        return max((part_cost(p, ranks) for p in LINK_PARTS.split(value) if p), default=0.0)
    if DOTTED.fullmatch(value):
        return max(part_cost(p, ranks) for p in re.split(r"[.()]+", value.strip("$")) if p)
    return guess_cost(value, ranks)


def bare(value: str) -> str:
    """A value without quotes, up to a bracket that it didn't open, without marks that end a sentence."""
    opened: list[str] = []
    for k, c in enumerate(value):
        if c in "([{":
            opened.append(c)
        elif c in CLOSED and (not opened or opened.pop() != CLOSED[c]):
            value = value[:k]
            break
    return value.rstrip(".:!?#*$%&|")


def dictionary(docs: DataFrame, most: int = MOST_WORDS) -> dict[str, int]:
    """Rank by frequency of the words that are one in ``most`` or more of all words of the corpus, each once a text."""
    text = F.lower(F.coalesce("text", F.lit("")))
    free = F.when(text.rlike("|".join(CONTEXT_CUES)), F.regexp_replace(text, CONTEXT_JVM, " ")).otherwise(text)
    words = F.filter(F.array_distinct(F.split(free, r"[^\p{L}]+")), lambda w: F.length(w).between(3, LONGEST_WORD))
    counts = stage(docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "words")
    least = max(2, -(-(counts.agg(F.sum("n")).first()[0] or 0) // most))
    known = sorted(((-r["n"], r["w"]) for r in counts.where(F.col("n") >= least).collect()))
    drop(counts)
    return {w: i + 1 for i, (_, w) in enumerate(known)}


def with_common(words: dict[str, int]) -> dict[str, int]:
    """Ranks of corpus words and of WORDS together; the better rank counts."""
    return words | {w: min(r, words.get(w, r)) for w, r in RANK.items()}


def base_spans(text: str, lower: str) -> list[Span]:
    out: list[Span] = []
    if any(c in lower for c in ASSIGN_CUES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"h" * 16 in text.encode("utf-8", "replace").translate(HEX_BYTES):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return out


def added_spans(text: str, lower: str, base: list[Span], ranks: dict[str, int]) -> tuple[list[Span], float | None]:
    """(spans of dear values, the dearest value's cost); the cost also counts values inside base spans."""
    out: list[Span] = []
    dearest = None
    if not any(c in lower for c in CONTEXT_CUES):
        return out, dearest
    for m in CONTEXT.finditer(text):
        value, start = (m[m.lastindex], m.start(m.lastindex)) if m.lastindex < 3 else (bare(m[3]), m.start(3))
        end = start + len(value)
        cost = value_cost(value, ranks)
        dearest = cost if dearest is None else max(cost, dearest)
        if cost >= DEAR and not any(a < end and start < b for a, b, _ in base):
            out.append((start, end, "guess"))
    return out, dearest


def search(text: str, ranks: dict[str, int] = RANK) -> tuple[list[Span], float | None]:
    lower = text.lower()
    base = base_spans(text, lower)
    added, cost = added_spans(text, lower, base, ranks)
    return base + added, cost


def find(text: str, ranks: dict[str, int] = RANK) -> list[Span]:
    return search(text, ranks)[0]


def secrets(docs: DataFrame, words: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, max_cost), a row for each row of ``docs``.

    ``max_cost``: log10 of the guesses of the dearest value in a credential context, null without one. ``words``
    ranks known words; those of ``docs`` itself if it isn't given.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(with_common(dictionary(docs) if words is None else words))
    return scan(docs, lambda text: search(text, ranks.value), BASE, ADDED, "max_cost")
