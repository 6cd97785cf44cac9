"""Grammars: whole token streams are taken or the first error is reported."""

import pytest

from lodestone.llm import syntax as S
from lodestone.llm.grammars.engine import Parser, Tokens

GOOD = {
    "py": ["match x:\n    case [1, *r] if y: pass\n    case _: pass\nasync def f(a, /, b: int = 1, *, c, **k) -> x:\n    return *a, b\n", "with open(a) as b, c:\n\tpass\nx = y = z[1:2, ::3]\nf'{a!r:>{w}} {{}}'\n", "", "# only a comment", "if (n := 1) > 0: pass\nelse:\n    del a, b[0]\n"],
    "js": ["import a, { b as c } from 'x';\nconst f = async (a, b) => { return a ?? b?.c; };\nlet r = /[/]\\/(a|b)/gi, t = `a${b + `c${d}`}e`\na = b\n++c\n", "for (const [a, b] of c) { d: continue }\nclass A extends B { static #p = 2; get v() { return this.#p } }", ""],
    "ts": ["export function f<T>(items: string[], limit?: number): items is T[] { return items as any; }\ninterface I { readonly a: string; [k: string]: any }\ntype X<T> = { [K in keyof T]?: T[K] } | null;\nabstract class A { private constructor(public a: string) {} }"],
    "go": ['package main\n\nimport (\n\t"fmt"\n)\n\nfunc (t *T) M(a, b int) (r int, err error) {\n\tif v, ok := m[a]; ok {\n\t\treturn\n\t}\n\tx := &T{\n\t\tA: 1,\n\t}\n\tfor i, r := range x {\n\t\t_ = r\n\t}\n}\n'],
    "java": ['package a.b;\nimport java.util.*;\npublic class A<T extends B> { private Map<String, List<Integer>> m = new HashMap<>(); int f(int... a) { for (String s : l) { if (s instanceof String t) return (int) 3.0; } Runnable q = () -> { x(); }; return a < b ? 1 : 2; } }\n'],
    "rs": ['use std::{fmt, io};\npub fn f<\'a>(x: &\'a str, v: Vec<String>) -> Vec<String> { for r in v.iter().take(3) { if r == "a" { continue; } } let c = |a| a + 1; match x { Some(n) if n > 3 => n, _ => 0 } }\n'],
    "c": ["#include <a.h>\nstatic const char *X = \"a\" \"b\";\nstruct s { int a:3; };\nint f(char **items, int limit) { for (int i = 0; i < limit; i++) { if (!items[i]) goto out; } out: return (int)limit; }\n"],
    "json": ['{"a": [1, 2.5e3, null, true], "b": {"c": "\\u00e9"}}', "1"],
    "yaml": ["a: 1\nb:\n  - x\n  - y: 1\n    z: 2\nc: {a: 1, b: [1, 2]}\nd: |\n  text: a\n   more\ne: \"multi\n  line\"\n", "- a\n- b: c\n", "plain text\n", "", "# c\n---\na: b # c\n...\n"],
    "toml": ['a = 1\n[b.c]\nd = "x"\ne = [1, 2,]\n[[f]]\ng = 2024-01-01T00:00:00Z\nh = {i = 1, j.k = true}\n', ""],
}
BAD = {
    "py": [("x =  = 3\n", 1), ("def f(:\n    pass\n", 1), ("if a:\npass\n", 2), ("def f():\n    x = (1,\n", 2), ("a = 1\n<<<<<<< ours\nb = 2\n", 2), ('print "x"\n', 1), ("def f():\n        a = 1\n\treturn a\n", 3), ("x = “a”\n", 1)],
    "js": [("function f(a { }\n", 1), ("let a = 1;\n=======\nlet b;\n", 2), ("def f(x):\n    return x\n", 1), ("const s = 'abc\n", 1), ("function f() {\n", 2)],
    "ts": [("function f(a: string[) {}\n", 1), ("package x\n\nfunc f() {}\n", 1)],
    "go": [("package a\nfunc f( {\n}\n", 2), ("x = 1\n", 1), ("package a\n\nfunc f() {\n", 4)],
    "java": [("class A { int f( { } }\n", 1), ("class A {\n", 2), ("func f() {}\n", 1)],
    "rs": [("fn f( { }\n", 1), ("pub fn f() -> {\n", 1), ("def f(x):\n    pass\n", 1)],
    "c": [("int f(int a {\n}\n", 1), ("int x = ;\n", 1), ("import os\nimport re\n", 2)],
    "json": [("{'a': 1}", 1), ("{\"a\": 1,}", 1), ("", 1), ("[1, 2", 1), ("{\"a\": 01}", 1)],
    "yaml": [("a: b: c\n", 1), ("a:\n  - b\nc\nd: 1\n", 3), ("a: [1, {b: 1\n", 1), ('a: "x\n', 1), ("a:\n\tb: 1\n", 2), ("a: 1\n<<<<<<< ours\nb: 2\n", 2)],
    "toml": [("a = \n", 1), ("a : 1\n", 1), ("[a\n", 1), ("a = 450[\n", 1), ('a = "x\n', 1)],
}


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in GOOD.items() for t in ts])
def test_takes(ext, text):
    assert S.grammar_error(ext, text) is None


@pytest.mark.parametrize("ext,text,line", [(e, *t) for e, ts in BAD.items() for t in ts])
def test_rejects_at_the_line(ext, text, line):
    found = S.first_error(f"a.{ext}", text)
    assert found is not None and abs(found[0] - line) <= 1


def test_unknown_extensions_are_never_cases():
    assert S.first_error("a.md", "def (") is None and S.first_error("Makefile", "((") is None


def test_truncation_of_a_valid_file_is_noticed_inside_brackets():
    text = GOOD["java"][0]
    for n in range(80, len(text) - 4, 7):
        assert S.grammar_error("java", text[:n]) is not None


def test_dispatch_tables_follow_first_sets():
    p = Parser("file = item* EOF\nitem = 'a' 'b' | 'a' 'c' | \"x\" | NUM", "file")

    def parse(*kinds):
        t = Tokens()
        for i, k in enumerate(kinds):
            t.put(*(k if isinstance(k, tuple) else (k, k)), False, i)
        t.put("EOF", "", True, len(kinds))
        return p.parse(t)

    assert parse("a", "c", "a", "b", ("NAME", "x"), "NUM") is None and parse("a", "d") == 1 and parse(("NAME", "y")) == 0 and parse() is None


def test_deep_nesting_does_not_crash():
    assert S.grammar_error("json", "[" * 3000 + "]" * 3000) is None
    assert S.grammar_error("json", "[" * 3000) is not None


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in GOOD.items() for t in ts] + [(e, t) for e, ts in BAD.items() for t, _ in ts])
def test_the_program_takes_what_the_calls_take(ext, text):
    try:
        tokens = S._LANGUAGES[ext][0](text)
    except S.LexError:
        return
    p = S._parser(ext)
    want = p.parse(tokens)
    p.kinds[:], p.texts[:], p.breaks[:] = tokens.kinds, tokens.texts, tokens.breaks
    p.far[0] = 0
    p.memo.clear()
    end = p.run_program()
    assert (end >= 0) == (want is None)
    if want is not None:
        assert tokens.places[min(p.far[0], len(tokens.places) - 1)] == want


@pytest.mark.parametrize("n", [20_000, 150_000])
def test_files_of_any_depth_are_parsed(n):
    assert S.grammar_error("json", "[" * n + "]" * n) is None
    assert S.grammar_error("json", "[" * n) is not None
    assert S.grammar_error("js", "x = " + "[" * n + "]" * n + ";") is None
    assert S.grammar_error("js", "x = " + "[" * n + ";") is not None


def test_grammars_agree_with_the_library_parsers(data):
    """Python, JSON and TOML files, and the same cut off in the middle, against the parsers of Python's library."""
    import ast
    import json
    import tomllib
    import warnings

    import pyarrow.parquet as pq

    from lodestone.llm.files import assemble

    def refuse(name):
        raise ValueError(name)

    library = {"py": ast.parse, "json": lambda t: json.loads(t, parse_constant=refuse), "toml": tomllib.loads}
    files = {}
    for r in pq.read_table(f"{data}/store_meta.parquet", columns=["file", "start_line", "end_line", "doc"]).to_pylist():
        if r["file"] and r["doc"] is not None and S.extension(r["file"]) in library:
            files.setdefault(r["file"], []).append(r)
    n = 0
    for file, parts in files.items():
        whole = assemble(parts)
        for text in (whole, whole[: len(whole) // 2], whole[: len(whole) // 3] + ")" + whole[len(whole) // 3 :]):
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    library[S.extension(file)](text)
                good = True
            except (ValueError, SyntaxError):
                good = False
            assert (S.grammar_error(S.extension(file), text) is None) == good, (file, text[-200:])
            n += 1
    assert n > 0
