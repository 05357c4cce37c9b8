"""Scopes of JavaScript, TypeScript, Java and Go, read by a lexer that knows strings, comments and brackets.

The lexer gives the text as marks: words, brackets and other signs, with the line each begins on. Strings,
templates (with the code inside ``${}``), characters, regular expressions and comments give no words, so what they say is
never taken for code. A stack of brackets tells which pair of braces a scope's body is; scopes nest by it.

What opens a scope is decided by the words of its head, from the end of the statement before: ``class``, ``interface``,
``enum`` and the like, functions and methods by their parentheses before the brace, and arrow functions that are given a name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

#: Scopes nested deeper than this are part of the one around them.
DEEPEST = 50

# Words that open a type's body, and those before parentheses and a brace that open none.
TYPES = {
    "javascript": {"class"},
    "typescript": {"class", "interface", "enum", "namespace", "module"},
    "java": {"class", "interface", "enum", "record"},
    "go": {"struct", "interface"},
}
CONTROL = {"if", "for", "while", "switch", "catch", "with", "synchronized", "try", "do", "else", "finally", "return", "new", "select", "case", "throw", "await", "typeof", "super", "this"}

_SPACE = re.compile(r"[ \t\r\f\v]+")
_WORD = re.compile(r"[A-Za-z_$@][\w$]*|\d[\w.]*|[^\W\d]\w*")
_QUOTED = {
    '"': re.compile(r'"(?:[^"\\\n]|\\.|\\\n)*"?', re.S),
    "'": re.compile(r"'(?:[^'\\\n]|\\.|\\\n)*'?", re.S),
}
_BLOCK = re.compile(r'"""(?:[^\\]|\\.)*?(?:"""|\Z)', re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: After these a slash divides; after anything else it opens a regular expression.
_VALUE = re.compile(r"[\w$)\]}]$")


class Mark(NamedTuple):
    line: int
    what: str


def marks(text: str, lang: str) -> Iterator[Mark]:
    """The words, brackets and signs of a text outside of strings and comments; a line feed is a sign too."""
    at, line, before, n = 0, 1, "", len(text)
    templates: list[int] = []  # depth of braces inside each open ${}
    script = lang in ("javascript", "typescript")
    close = -2  # place of the next end of a comment, looked for once
    plain = 0  # up to where slashes are known to divide
    while at < n:
        c = text[at]
        if c == "\n":
            yield Mark(line, "\n")
            at, line = at + 1, line + 1
            continue
        if m := _SPACE.match(text, at):
            at = m.end()
            continue
        end = -1
        if text.startswith("//", at):
            end = text.find("\n", at)
            end = n if end < 0 else end
        elif text.startswith("/*", at):
            if close != -1 and close < at + 2:
                close = text.find("*/", at + 2)
            end = n if close < 0 else close + 2
        elif lang == "java" and text.startswith('"""', at):
            end = _BLOCK.match(text, at).end()
        elif c in _QUOTED and (m := _QUOTED[c].match(text, at)):
            end = m.end()
        elif c == "`":
            end = _template(text, at + 1, lang, templates)
        elif c == "}" and templates and templates[-1] == 0:
            templates.pop()
            end = _template(text, at + 1, lang, templates)
        elif c == "/" and script and at >= plain and not _VALUE.search(before):
            if m := _REGEX.match(text, at):
                end = m.end()
            else:  # none closes on this line, so its slashes divide
                plain = text.find("\n", at)
                plain = n if plain < 0 else plain
        if end >= 0:
            line += text.count("\n", at, end)
            if not text.startswith(("//", "/*"), at):
                before = ")"  # a value
            at = end
            continue
        if m := _WORD.match(text, at):
            yield Mark(line, m[0])
            before = " " if m[0] in CONTROL else m[0]
            at = m.end()
            continue
        if templates and c in "{}":
            templates[-1] += 1 if c == "{" else -1
        what = "=>" if text.startswith("=>", at) else c
        yield Mark(line, what)
        before, at = what, at + len(what)


def _template(text: str, at: int, lang: str, templates: list[int]) -> int:
    """The end of a template's literal part: past its closing mark, or past a ``${``, after which code goes on."""
    n = len(text)
    while at < n:
        if text[at] == "\\" and lang != "go":
            at += 2
        elif text[at] == "`":
            return at + 1
        elif lang != "go" and text.startswith("${", at):
            templates.append(0)
            return at + 2
        else:
            at += 1
    return n


class Scope(NamedTuple):
    line: int
    depth: int
    kind: str
    name: str
    last: int


def _kind(head: list[Mark], lang: str, within: str | None) -> tuple[str, str] | None:
    """What a brace opens after ``head``, the marks since the last statement: (kind, name), or none for a plain block."""
    words = _without_annotations([m.what for m in head])
    if not words:
        return None
    for k, w in enumerate(words):
        if w in TYPES[lang] and not (lang == "java" and k and words[k - 1] == ".") and "(" not in words[:k] and "=" not in (words[:k] if lang != "go" else []):
            name = next((x for x in words[k + 1 :] if x[0].isalpha() or x[0] in "_$"), "")
            if lang == "go":
                return ("type", words[k - 1]) if k and (words[0] == "type" or within == "types") else None
            return w, name
    if lang == "go":
        if words[0] == "func":
            after = words[words.index(")") + 1 :] if words[1:2] == ["("] and ")" in words else words[1:]
            return "function", after[0] if after and after[0] != "(" else ""
        return None
    if lang != "java":
        if "function" in words:
            k = words.index("function")
            name = next((x for x in words[k + 1 : k + 3] if x not in ("*", "(")), "")
            return "function", name or (words[words.index("=") - 1] if "=" in words[:k] else "")
        if words[-1] == "=>":
            return ("function", words[words.index("=") - 1]) if "=" in words and words.index("=") else None
    if "(" in words and ")" in words and (within in TYPES[lang] or lang == "java"):
        k = words.index("(")
        end = k
        if k and words[k - 1] == ">":  # type parameters stand between name and parentheses
            end = words.index("<") if "<" in words[:k] else k
            if lang == "java":
                end = k
        name = words[end - 1] if end else ""
        if name and (name[0].isalpha() or name[0] in "_$#") and not CONTROL & set(words[:k]) and "=" not in words[:k] and "->" not in words:
            return "method", name
    return None


def _without_annotations(words: list[str]) -> list[str]:
    """``words`` without ``@name`` and the parentheses after it; ``@interface`` stays."""
    out, k = [], 0
    while k < len(words):
        if not words[k].startswith("@") or words[k] == "@interface":
            out.append(words[k].lstrip("@"))
            k += 1
            continue
        k += 1
        while k + 1 < len(words) and words[k] == ".":
            k += 2
        if words[k : k + 1] == ["("]:
            depth = 0
            for k in range(k, len(words)):
                depth += (words[k] == "(") - (words[k] == ")")
                if not depth:
                    break
            k += 1
    return out


def scopes_of(text: str, lang: str) -> list[Scope]:
    """The scopes of a text with their first and last lines; depth 0 is outermost. Braces that never close end with the text."""
    out: list[Scope] = []
    head: list[Mark] = []
    opened: list[tuple[str, int | None, str | None]] = []  # bracket, place in out, kind
    held: list[list[Mark]] = []  # the head that goes on after each open brace, and what the brace opened
    bodies: list[str | None] = []
    depth, line = 0, 1
    for mark in marks(text, lang):
        line, what = mark
        if what == "{":
            grouped = bool(opened) and opened[-1][2] == "types"
            within = "types" if grouped else bodies[-1] if bodies else None
            inside = not opened or opened[-1][0] == "{" or grouped  # an object or a block in parentheses opens nothing
            found = _kind(head, lang, within) if inside and depth <= DEEPEST else None
            if found:
                first = head[0].line
                out.append(Scope(first, depth, *found, -1))
                depth += 1
            opened.append(("{", len(out) - 1 if found else None, found[0] if found else None))
            if inside:
                head = []
            else:
                head.append(mark)
            held.append(head)
            bodies.append(found[0] if found else None)
            head = []
        elif what in "([":
            opened.append((what, None, "types" if what == "(" and len(head) == 1 and head[0].what == "type" else None))
            head.append(mark)
        elif what in ")]":
            if opened and opened[-1][0] == ("(" if what == ")" else "["):
                opened.pop()
            head.append(mark)
        elif what == "}":
            while opened and opened[-1][0] != "{":
                opened.pop()
            if opened:
                place = opened.pop()[1]
                if place is not None:
                    depth -= 1
                    out[place] = out[place]._replace(last=line)
                bodies.pop()
            head = held.pop() if held else []
        elif what == ";" and (not opened or opened[-1][0] == "{"):
            head = []
        elif what == "\n":
            if lang == "go" and (not opened or opened[-1][0] == "{" or opened[-1][2] == "types"):
                head = []
            elif head and lang in ("javascript", "typescript") and (not opened or opened[-1][0] == "{") and _ended(head):
                head = []
        elif what == "," and opened and opened[-1][0] == "{":
            head = []
        else:
            head.append(mark)
    return [s if s.last >= 0 else s._replace(last=line) for s in out]


def _ended(head: list[Mark]) -> bool:
    """Whether a line's end ends a statement: what it ends with opens nothing, and it isn't the head of a function or type."""
    words = [m.what for m in head]
    return words[-1] not in ("=", "=>", ",", "(", "extends", "implements", ":", ".", "&", "|", "?", "+") and not ({"class", "interface", "function", "enum", "namespace"} & set(words)) and words[-1] != ")" and not words[0].startswith("@") and words[-1] not in ("async", "export", "default", "static", "public", "private", "protected")

