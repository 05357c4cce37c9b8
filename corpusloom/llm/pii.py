"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs,
plus signs and dots beside a digit, digits, address schemes and identifier cues.
At each anchor a small local parser expands to the left and right and validates
what it has: e-mail addresses, IP addresses, card numbers (Luhn), phone numbers;
beyond these base kinds, ``url`` for addresses that carry a user name or a mail
address and ``account`` for account numbers after a cue (IBAN checksum, or 6 to
17 digits with separators).

Expansion gives the leftmost non-overlapping matches of the base patterns: a
parser starts at the left end of the run that its anchor lies in, but not before
the end of the last match of its kind, and a match that fails validation still
uses up its characters.

Cases. Null or empty text: no spans. Repeated rows are scanned each; an empty table gives
an empty one. Texts are scanned whole, in time that grows with their length. An anchor
inside the last match of its kind is passed over. Spans that start together stand in the
order of the kinds. Of the input only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame

from corpusloom.llm.spans import Span, scan

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "account")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DIGITS = frozenset("0123456789")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
USER_IN_URL = re.compile(r"://[^/@\s]+@|[?&](?:user|email|mail|login|account|phone|ssn)=[^&\s]+", re.IGNORECASE | re.ASCII)
ACCOUNT = re.compile(
    r"(?:\x20?(?:number|no\.?|nr\.?|num|id|#))?[\"']?\x20?(?:[:=#]|is)?\x20?[\"']?"
    r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}|[0-9](?:[\x20-]?[0-9]){5,16})(?![A-Za-z0-9])",
    re.ASCII | re.IGNORECASE,
)
SCHEMES = ("http://", "https://", "ftp://")
# Words that announce an account or identity number.
CUES = ("account", "acct", "iban", "ssn", "passport", "routing", "konto", "compte", "cuenta", "customer id", "user id", "tax id")


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
        a.add_word(f"+{d}", ("phone", 2))
        a.add_word(f"{d}.", ("ip", 2))
    for s in SCHEMES:
        a.add_word(s, ("url", len(s)))
    for c in CUES:
        for form in {c, c.capitalize(), c.upper()}:
            a.add_word(form, ("account", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        k = int(d) * (1 + i % 2)
        total += k - 9 * (k > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    v = re.sub(r"\s", "", value).upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def run_start(text: str, at: int, least: int, chars: frozenset[str]) -> int:
    """The left end of the run of ``chars`` that ends before ``at``, not before ``least``."""
    while at > least and text[at - 1] in chars:
        at -= 1
    return at


def find(text: str) -> list[Span]:
    spans: list[Span] = []
    done = dict.fromkeys(BASE + ADDED, 0)
    for last, (kind, size) in automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at < done["card"]:
                continue
            m = CARD.match(text, at)
            done["card"] = m.end() if m else at + 1
            if m and 12 <= len(digits := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(digits):
                spans.append((at, m.end(), "card"))
        elif at < done[kind]:
            continue
        elif kind == "email":
            start = run_start(text, at, done["email"], LOCAL)
            if start < at and (m := DOMAIN.match(text, at)):
                done["email"] = m.end()
                spans.append((start, m.end(), "email"))
        elif kind == "ip":
            start = run_start(text, at, done["ip"], DIGITS)
            if m := IP.match(text, start):
                done["ip"] = m.end()
                if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split(".")):
                    spans.append((start, m.end(), "ip"))
        elif kind == "phone":
            if m := PHONE.match(text, at):
                done["phone"] = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    spans.append((at, m.end(), "phone"))
        elif kind == "url":
            m = URL.match(text, at)
            done["url"] = m.end()
            if USER_IN_URL.search(m[0]):
                spans.append((at, at + len(m[0].rstrip(".,;:!?)")), "url"))
        elif (at == 0 or not text[at - 1].isalnum()) and (m := ACCOUNT.match(text, last + 1)):
            done["account"] = m.end()
            if m[1][0] in DIGITS or iban(m[1]):
                spans.append((m.start(1), m.end(1), "account"))
    return spans


def personal(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), a row for each row of ``docs``."""
    return scan(docs, find, BASE, ADDED)
