"""Scopes of four languages by the lexer: what is code and what only looks like it, nesting, depth, time."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.operators import chunking
from corpusloom.operators.scopes import DEEPEST, scopes_of

JS = '''import x from "y"; // class Nope {
/* class Nope2 { function z() {} */
const re = /class Foo {/g, t = `class Bar { ${ (() => { return `in${1}` })() } function q() {}`;
export default class Large extends Base {
  static #n = 1;
  constructor(a = {b: 1}) { super(a); if (a) { x() } }
  async *gen() { for (const i of []) { yield i } }
  get size() { return 1 }
  handler = (e) => {
    return e / 2
  }
}
export async function load(url, { a, b } = {}) {
  const inner = function named() { return 1 / 2 / 3 }
  while (x) { y({ z() { } }) }
}
const arrow = async (a) => { return { k: 1 } }
if (a) { b() }
'''
TS = '''export interface A<T> {
  m(a: number): void;
}
@Component({ selector: "x", template: `<b>` })
namespace N {
  export enum E { A, B }
  abstract class C<T> implements A<T> {
    private readonly x: string = "class D {";
    constructor(private y: number) { }
    public async go<T>(a: T): Promise<T> { return a }
  }
}
type X = { a: number }
'''
JAVA = '''package a.b;
/** class Doc { } */
@Service("class X {")
public final class Big<T extends Foo> implements Bar {
    private static final String S = """
       class InText { void f() {} }
       """;
    static { init(); }
    @Override(value = {1})
    public int run(int a) throws IOException {
        try { x(); } catch (Exception e) { }
        Runnable r = () -> { go(); };
        char c = '{';
        return 2;
    }
    enum Color { RED, GREEN; int f() { return 1; } }
    record P(int x, int y) { }
}
interface I { void m(); default int d() { return 1; } }
'''
GO = '''package main
// func nope() {
type P struct {
	X int `json:"class {"`
}
type (
	A struct { X int }
	B interface { M() }
)
func (p *P) Do(a int, f func(int) error) (int, error) {
	g := func() { fmt.Println("func x() {") }
	if a > 0 { return 1, nil }
	return 2, nil
}
func main() {
	s := `raw func y() {
	}`
}
'''


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("javascript", JS, [(4, 0, "class", "Large", 12), (6, 1, "method", "constructor", 6), (7, 1, "method", "gen", 7), (8, 1, "method", "size", 8), (9, 1, "function", "handler", 11), (13, 0, "function", "load", 16), (14, 1, "function", "named", 14), (17, 0, "function", "arrow", 17)]),
        ("typescript", TS, [(1, 0, "interface", "A", 3), (4, 0, "namespace", "N", 12), (6, 1, "enum", "E", 6), (7, 1, "class", "C", 11), (9, 2, "method", "constructor", 9), (10, 2, "method", "go", 10)]),
        ("java", JAVA, [(3, 0, "class", "Big", 18), (9, 1, "method", "run", 15), (16, 1, "enum", "Color", 16), (16, 2, "method", "f", 16), (17, 1, "record", "P", 17), (19, 0, "interface", "I", 19), (19, 1, "method", "d", 19)]),
        ("go", GO, [(3, 0, "type", "P", 5), (7, 0, "type", "A", 7), (8, 0, "type", "B", 8), (10, 0, "function", "Do", 14), (15, 0, "function", "main", 18)]),
    ],
)
def test_scopes(lang, text, want):
    assert [tuple(s) for s in scopes_of(text, lang)] == want


@pytest.mark.parametrize("lang", ["javascript", "typescript", "java", "go", "python", None])
def test_chunks_keep_every_character(lang):
    text = {"javascript": JS, "typescript": TS, "java": JAVA, "go": GO}.get(lang, "class A:\n    def f(self):\n        pass\n") * 20
    for most in (50, 200, 1000):
        assert "".join(c[2] for c in chunking.scope_chunks(text, lang, most)) == text


def test_methods_of_a_large_class_are_cut_points():
    text = "class Large {\n" + "".join(f"  m{k}() {{\n    // class Fake {{\n    return 'x';\n  }}\n" for k in range(30)) + "}\n"
    chunks = chunking.scope_chunks(text, "javascript", 300)
    assert len(chunks) > 3 and all(len(c[2]) <= 300 and not c[3] for c in chunks) and all(c[2].lstrip().startswith("m") for c in chunks[1:])


def test_depth_is_bounded():
    for lang, opening in (("javascript", "class A {\n"), ("java", "class A {\n"), ("typescript", "namespace A {\n")):
        found = scopes_of(opening * 200 + "}\n" * 200, lang)
        assert max(s.depth for s in found) == DEEPEST == 50 and len(found) == DEEPEST + 1
    deep = "".join(" " * k + f"class A{k}:\n" for k in range(90)) + " " * 90 + "pass\n"
    assert max(s.depth for s in chunking.scopes_in(deep, "python")) == DEEPEST


@pytest.mark.parametrize("piece", ["{", "({", "`${", "/*", '"', "class A {\n", "f({a: 1}, ", "@x(", "func (", "/[", "}", "`", "\\", "'''", '"""', "type (\n"])
def test_time_grows_with_length(piece):
    for lang in ("javascript", "typescript", "java", "go"):
        began = time.monotonic()
        scopes_of(piece * 30_000, lang)
        assert time.monotonic() - began < 4, lang


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["class A ", "{", "}", "(", ")", "'", '"', "`", "${", "/", "*/", "/*", "//", "\n", "f", "=>", "=", ";", "func ", "type ", "\\", "@", "é"]), max_size=40), st.sampled_from(["javascript", "typescript", "java", "go"]))
def test_any_text_is_read(pieces, lang):
    text = "".join(pieces)
    for s in scopes_of(text, lang):
        assert 1 <= s.line <= s.last <= text.count("\n") + 1 and s.depth >= 0
    assert "".join(c[2] for c in chunking.scope_chunks(text, lang, 10)) == text
