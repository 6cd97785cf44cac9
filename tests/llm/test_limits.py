"""Limits that are gone: cases that a cut of lines, characters or rows would lose."""

import numpy as np
import pytest

from lodestone.llm import credentials as C
from lodestone.llm import neighbours
from lodestone.llm.handwritten import signs
from lodestone.llm.sentences import Lattice, lattice, sentences

_CODE = "def first(a):\n    return a\n"
_LICENCE = "Permission is hereby granted, free of charge, to any person\n\n"


@pytest.mark.parametrize(
    "file,text,want",
    [
        ("a/x.py", "# Permission is hereby granted\n#\n" * 15 + "# Code generated by t v1; DO NOT EDIT.\n" + _CODE, "generated"),
        ("a/x.go", "/*\n" + _LICENCE * 15 + "*/\n\n// Code generated by t v1; DO NOT EDIT.\npackage x\n", "generated"),
        ("a/x.c", "/*\n" + _LICENCE + "This is a verbatim copy of foo.\n*/\nint a;\n", "vendored"),
        ("a/x.py", '"""\nCode generated by t v1; DO NOT EDIT.\n"""\n' + _CODE, "generated"),
        ("a/x.py", "# Permission is hereby granted\n" * 30 + _CODE + "# Code generated by t v1; DO NOT EDIT.\n", None),
        ("a/x.js", "/* Helpers. */ var a = 1;\n// Code generated by t v1; DO NOT EDIT.\n", None),
        ("a/x.py", '"""Reads files."""\n' + _CODE + '"""\nCode generated by t.\n"""\n', None),
    ],
)
def test_marks_anywhere_in_the_leading_comment(file, text, want):
    assert signs(file, text) == want


def test_ties_inside_a_leaf_go_to_the_smaller_ids():
    ids = np.random.default_rng(3).permutation(40)
    x = np.tile(np.eye(1, 64), (40, 1)) * (1 + 1e-12 * ids[:, None])
    a, b, _ = next(neighbours._top(ids, x, 12, 512))
    assert all(sorted(b[a == i]) == [j for j in range(40) if j != i][:12] for i in ids)


@pytest.mark.parametrize("n", [100, 599, 601, 900, 20_000])
def test_credentials_of_any_length(n):
    value = ("aB3dE9fG7hJ2" * (n // 12 + 1))[:n]
    assert C.find_credentials(f'api_token = "{value}"') == [(13, 13 + n)]


def test_names_far_before_their_literal():
    text = "password" + " " * 500 + '= "Copper-lantern5151#"'
    assert len(C.find_credentials(text)) == 1
    many = 'f("a", ' * 3000 + '"x"' + ")" * 3000 + '; token = "gjRhEVbt.d0YK_hcaNu3YnzZwr7FQQu2nTVD"'
    assert len(C.find_credentials(many)) == 1


def test_a_long_key_behind_other_text():
    head = "Proc-Type: 4,ENCRYPTED\n" * 12
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + head + ("aB3+" * 16 + "\n") * 5 + "-----END RSA PRIVATE KEY-----\n"
    assert len(C.find_credentials(pem)) == 1
    assert C.find_credentials("-----BEGIN RSA PRIVATE KEY-----\n" + "<your key here>\n" * 30 + "-----END RSA PRIVATE KEY-----\n") == []


@pytest.mark.parametrize("n", [20, 80, 400])
@pytest.mark.parametrize("marks", ['""', "“”", "()", "「」"])
def test_quotations_of_any_length_hold_their_marks(n, marks):
    text = f"He said {marks[0]}{'One came. Two went. ' * n}Last{marks[1]} and left. Next one."
    got = [text[a:b] for a, b in sentences(text)]
    assert len(got) == 2 and got[1] == "Next one."


def test_a_stray_quote_does_not_swallow_the_next_quotation():
    text = 'A 5" disk "fails. Badly" today. It is "old. Very" now. End.'
    assert [text[a:b] for a, b in sentences(text)][-1] == "End."


def test_lattice_takes_the_cheapest_path():
    t = Lattice(["今日", "は", "今日は", "晴れ", "日は"])
    assert t.words("今日は晴れ") == ["今日は", "晴れ"] and t.words("x今日") == ["x", "今日"] and t.words("") == []
    assert lattice().words("ありがとうございます") == ["ありがとうございます"]


@pytest.mark.parametrize(
    "text,n",
    [
        ("「終わった。」と彼は言った。次。", 2), ("「終わった。」彼は帰った。次。", 3), ("“完了了。”然后他走了。下一句。", 3), ("“完了了。”的时候他走了。下一句。", 2),
        ("ヤフー！の記事です。次です。", 2), ("もう終わりですか？はい、そうです。", 2), ("为什么这么慢？他走了。", 2), ("そうです。でも違います。", 2),
    ],
)
def test_words_decide_gaps_of_spaceless_scripts(text, n):
    assert len(sentences(text)) == n


def test_copies_of_other_lengths_keep_the_smaller_ids(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=64)
    rows = [(i, [float(c) for c in (x * (1 + i / 7)).astype(np.float32)]) for i in range(40)]
    got = {tuple(r) for r in neighbours.similar_pairs(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    want = {(min(i, j), max(i, j)) for i in range(40) for j in [k for k in range(40) if k != i][:5]}
    assert got == want
