"""Reference operators on small cases: nulls, empty texts, ties, repeats, empty tables, clashing columns."""

from datetime import datetime, timedelta

import pyspark.sql.functions as F
import pytest

from lodestone.functions import text as T
from lodestone.operators import evaluation, graph, ingest, rules, search
from lodestone.operators.syntax_chunks import syntax_spans, used_names
from lodestone.streaming import events as S


def col(spark, f, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    return [r[0] for r in df.select(f(df["c"])).collect()]


def test_search_tokens(spark):
    assert col(spark, T.search_tokens, "parseHTTPServer_v2 XMLFile foo-bar", "", None) == [["parse", "http", "server", "v", "2", "xml", "file", "foo", "bar"], [], None]


def test_paths(spark):
    assert col(spark, T.file_name, "a\\b/c.py", "x", None) == ["c.py", "x", None]
    assert col(spark, T.language_of, "a/b.PY", "a/b.zig", "noext") == ["python", "zig", ""]
    assert col(spark, T.normal_path, "./A\\B.py") == ["a/b.py"]


def test_symbols(spark):
    assert col(spark, T.looks_like_symbol, "load_graph", "MAX", "fooBar", "word", "ab", "_x", "the") == [True, True, True, False, False, False, False]


def test_sigmoid_of_odd_numbers(spark):
    got = col(spark, T.sigmoid, float("nan"), float("inf"), 0.0, kind="double")
    assert got[0] == 0.5 and got[1] > 0.99 and got[2] == 0.5


def test_windows(spark):
    files = spark.createDataFrame([("a", "\n".join(f"line number {i}" for i in range(1, 66)), 1), ("b", "", 2), ("c", None, 3), ("d", "short", 4)], "file string, text string, chunk_x int")
    got = sorted((r.file, r.start_line, r.end_line) for r in ingest.window_chunks(files).collect())
    assert got == [("a", 1, 40), ("a", 26, 65)]


def test_split_large_keeps_line_numbers(spark):
    chunk = spark.createDataFrame([("a", 0, 101, 180, "\n".join(f"long line of text {i}" for i in range(80)))], "file string, chunk int, start_line int, end_line int, text string")
    got = sorted((r.start_line, r.end_line) for r in ingest.split_large(chunk, 300).collect())
    assert got == [(101, 140), (126, 165), (151, 180)]


@pytest.mark.parametrize(
    "file,text,start,symbol,changed,want",
    [
        ("src/foo/test_bar.py", "def test_x(): pass", 10, "test_x", False, "test"),
        ("src/foo/bar.py", '"""doc"""', 1, None, False, "module"),
        ("tests/test_x.py", "def test_y(): pass", 10, "test_y", True, "change"),
        ("src/foo.py", "class Foo:\n    def a(self): ...\n    def b(self): ...", 20, "Foo", False, "interface"),
        ("src/foo.py", "return 1\nx = 2", 20, "Foo", False, "behavior"),
        ("src/foo.py", "x = 2", 20, "", False, "symbol"),
    ],
)
def test_chunk_class(spark, file, text, start, symbol, changed, want):
    df = spark.createDataFrame([(file, text, start, symbol, changed)], "f string, t string, s int, y string, c boolean")
    assert df.select(ingest.chunk_class(F.col("f"), F.col("t"), F.col("s"), F.col("y"), F.col("c"))).first()[0] == want


def test_change_status_and_upsert(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "file string, hash string")
    new = spark.createDataFrame([("b", "3"), ("c", None), ("d", "4")], "file string, hash string")
    assert {(r.file, r.status) for r in ingest.change_status(old, new).collect()} == {("a", "removed"), ("b", "updated"), ("c", "unchanged"), ("d", "new")}
    assert {(r.file, r.hash) for r in ingest.upsert(old, new, ["file"]).collect()} == {("a", "1"), ("b", "3"), ("c", None), ("d", "4")}


def test_syntax_chunks():
    text = '"""doc"""\nimport os\nCONST = 1\n\n\ndef alpha(x):\n    return x + 1\n\n\nclass Service:\n    @property\n    def handle(self):\n        return 1\n\n    async def fetch(self):\n        return 2\n'
    assert {s for _, _, s in syntax_spans(text)} == {"<module header>", "alpha", "class Service", "Service.handle", "Service.fetch"}
    assert syntax_spans("") == []
    broken = "def oops(:\n" * 20
    assert syntax_spans(broken)[0] == (1, 21, None)


def test_used_names_leave_out_comments_and_strings():
    assert used_names("ab = cd('x')  # ef\n", True) == {("ab", 1), ("cd", 1)}
    assert ("ef", 1) not in used_names("ab(/* ef */ 'gh')", False)


def test_merge_ranges_are_disjoint_and_cover(spark):
    rows = [("f", 10, 20, 200), ("f", 80, 90, 200), ("f", 80, 90, 200), ("f", 190, 199, 200), ("g", 1, 1, 1)]
    got = sorted((r.file, r.start_line, r.end_line) for r in search.merge_ranges(spark.createDataFrame(rows, "file string, start_line int, end_line int, last_line int")).collect())
    assert got == [("f", 1, 120), ("f", 160, 200), ("g", 1, 1)]


def test_fusion_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, 5, 0), (1, 6, 1)], "query_id bigint, id bigint, rank0 int")
    b = spark.createDataFrame([(1, 6, 0), (1, 7, 1)], "query_id bigint, id bigint, rank0 int")
    x = {(r.id, round(r.fused, 9)) for r in search.fuse([(a, 0.5), (b, 0.5)]).collect()}
    assert x == {(r.id, round(r.fused, 9)) for r in search.fuse([(b, 0.5), (a, 0.5)]).collect()}
    assert dict(x)[6] == round(0.5 / 61 + 0.5 / 60, 9)


def test_nearest_in_many_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "id bigint, embedding array<float>")
    q = v.where("id < 3").select(F.col("id").alias("query_id"), "embedding")
    one = {tuple(r) for r in search.nearest(v, q, 5).collect()}
    assert one == {tuple(r) for r in search.nearest(v, q, 5, query_block=2, row_block=7).collect()}
    assert sorted(r[1] for r in one if r[0] == 1) == [6, 13, 20, 27, 34]


def test_bm25_of_empty_tables(spark):
    docs = spark.createDataFrame([], "id bigint, text string")
    q = spark.createDataFrame([(1, "word")], "query_id bigint, text string")
    assert search.LexicalIndex.of(docs).search(q, 5).count() == 0


def _bm25(texts, query, k1=1.5, b=0.75):
    """Scores by the formula, one text at a time."""
    import math
    from collections import Counter

    toks = {i: t.split() for i, t in texts.items() if t}
    mean = sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for i, t in toks.items():
        tf = Counter(t)
        s = [(low if raw[w] < 0 else raw[w]) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / mean)) for w in query.split() if w in tf]
        if s:
            out[i] = round(sum(s), 6)
    return out


def test_bm25_against_the_formula_and_through_a_written_index(spark, tmp_path):
    texts = {1: "alpha beta beta gamma", 2: "beta gamma", 3: "alpha alpha alpha delta", 4: "", 5: None, 6: "beta", 7: "omega " * 300 + "delta"}
    docs = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    q = spark.createDataFrame([(1, "alpha beta beta"), (2, "delta nothing"), (3, ""), (4, None)], "query_id bigint, text string")
    index = search.LexicalIndex.of(docs)
    index.write(str(tmp_path / "ix"))
    for x in (index, search.LexicalIndex.open(spark, str(tmp_path / "ix"))):
        got = {(r.query_id, r.id): round(r.score, 6) for r in x.search(q, 10).collect()}
        assert got == {(1, i): s for i, s in _bm25(texts, "alpha beta beta").items()} | {(2, i): s for i, s in _bm25(texts, "delta nothing").items()}
    assert [r.id for r in index.search(q, 1).where("query_id = 2").collect()] == [3]
    index.MOST_SENT = 0  # the shuffled join
    assert index.search(q, 10).count() == len(got)


def test_covering_chunk_falls_back_to_the_nearest(spark):
    c = spark.createDataFrame([("f", "c0", 1, 40), ("f", "c1", 26, 65), ("f", "c9", 300, 340)], "file string, chunk_id string, start_line int, end_line int")
    p = spark.createDataFrame([(1, "f", 30), (2, "f", 64), (3, "f", 290), (4, "g", 1)], "point_id bigint, file string, line int")
    assert {tuple(r) for r in search.covering_chunk(p, c).collect()} == {(1, "c0", True), (2, "c1", True), (3, "c9", False)}


def test_blocks_never_exceed_the_budget(spark):
    rows = [(1, r, f"f{r % 4}", 500 * (r % 4 + 1), 1 + 10 * r, 20 + 10 * r, 400, 300 + 100 * (r % 4)) for r in range(12)]
    df = spark.createDataFrame(rows, "query_id bigint, rank0 int, file string, file_chars int, start_line int, end_line int, last_line int, file_tokens bigint")
    got = search.emit_blocks(df, 900, 30).orderBy("pos").collect()
    assert got and max(r.used for r in got) <= 900


def test_multi_hop_grows(spark):
    e = spark.createDataFrame([("a", "b", "IMPORTS", 1.0), ("b", "c", "IMPORTS", 1.0), ("c", "a", "IMPORTS", 1.0), ("a", "b", "IMPORTS", 2.0), (None, "b", "X", 1.0)], "src_id string, dst_id string, kind string, weight double")
    s = spark.createDataFrame([("a", "a")], "seed string, id string")
    one = {r.id for r in graph.multi_hop(e, s, 1).collect()}
    two = {(r.id, r.hop, r.weight) for r in graph.multi_hop(e, s, 2).collect()}
    assert one == {"b"} and two == {("b", 1, 2.0), ("c", 2, 3.0)}


def test_importers_by_parts_of_any_length(spark):
    i = spark.createDataFrame([("f", "os", 1, "r"), ("f", "a.json", 2, "r"), ("g", None, 3, "r")], "file string, target string, line int, repo string")
    w = spark.createDataFrame([("json",), ("o",), ("os",), (None,)], "part string")
    assert {(r.part, r.target) for r in graph.importers(i, w).collect()} == {("json", "a.json"), ("o", "os"), ("o", "a.json"), ("os", "os")}


def test_confidence_bands(spark):
    rows = [(0.9, 0.4, True, False, False, False, 3, 5, False, None), (0.0, 0.0, False, False, False, False, 0, 0, False, None), (0.95, 0.0, True, False, False, False, 2, 4, False, "DEBUG"), (0.95, 0.0, True, True, False, False, 3, 4, False, "DEBUG")]
    df = spark.createDataFrame(rows, "t double, u double, a boolean, b boolean, g boolean, r boolean, f int, k int, s boolean, i string")
    c = rules.confidence(*[F.col(x) for x in "tuabgrfks"])
    got = [(r[0], r[1]) for r in df.select(c, rules.policy(c, F.col("k"), F.col("i"))).collect()]
    assert got[0][0] > 0.7 and got[1] == (0.0, "ASK_CLARIFY") and got[3][1] == "ONE_MORE_ROUND"


def test_enrichment(spark):
    turns = [(1, 0, "assistant", "See src/auth.py\n```python\ndef validate_token(t):\n    raise E('expired token')\n```"), (1, 1, "user", "fix it"), (2, 0, "user", "explain how vector_store delete_by_file removes ids"), (3, 0, "user", None)]
    got = {(r.conv_id): r for r in rules.enrich(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got[1].enriched and "validate_token" in got[1].query and "expired token" in got[1].query
    assert not got[2].enriched and not got[3].enriched


def test_longest_name_first(spark):
    assert col(spark, lambda c: rules.mentioned_names(c, ["atlas", "atlas-core"]), "in Atlas-Core now", "atlas only", "") == [["atlas-core"], ["atlas"], []]


T0 = datetime(2024, 1, 1)


def ev(spark, *rows):
    return spark.createDataFrame([(i, k, T0 + timedelta(seconds=s)) for i, k, s in rows], "event_id bigint, k string, ts timestamp_ntz")


def test_storm(spark):
    got = {r.event_id: r.n for r in S.trailing_counts(ev(spark, (1, "a", 0), (2, "a", 1), (3, "b", 2), (4, "a", 5)), 2).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}


def test_debounce_counts_from_the_last_accepted(spark):
    got = sorted(r.event_id for r in S.debounce(ev(spark, (1, "a", 0), (2, "a", 1), (3, "a", 2), (4, "a", 3), (5, "b", 1)), "k", 2).collect())
    assert got == [1, 3, 5]


def test_first_observation_is_no_change(spark):
    df = spark.createDataFrame([(1, "r", "x"), (2, "r", "x"), (3, "r", "y")], "at int, repo string, head string")
    assert [(r.at, r.before) for r in S.changes(df, "repo", "at", "head").collect()] == [(3, "x")]


def test_metrics(spark):
    gold = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "case_id bigint, id bigint")
    cited = spark.createDataFrame([(1, 11, 1)], "case_id bigint, id bigint, rank0 int")
    got = {r.case_id: (r.recall, r.rr, r.passed) for r in evaluation.case_metrics(gold, cited).collect()}
    assert got == {1: (0.5, 0.5, True), 2: (0.0, 0.0, False)}


def test_extra_columns_with_clashing_names(spark):
    from lodestone.operators import hierarchy, orphans

    r = spark.createDataFrame([("t", 1, "a", T0, "x", 1)], "src_table string, row_id bigint, key string, seen_at timestamp_ntz, spans string, _known int")
    t = spark.createDataFrame([("a", T0, None, "y")], "key string, created_at timestamp_ntz, removed_at timestamp_ntz, reason string")
    assert orphans.find_orphans(r, t).count() == 0
    links = spark.createDataFrame([("b", "a", "x", 5)], "child string, parent string, root_id string, depth int")
    assert {(x.node_id, x.depth) for x in hierarchy.build_hierarchy(links).collect()} == {("a", 0), ("b", 1)}
    files = spark.createDataFrame([("f", "a long enough line of text here", 1, 2, 3)], "file string, text string, chunk int, start_line int, end_line int")
    assert [(x.chunk, x.start_line) for x in ingest.window_chunks(files).collect()] == [(0, 1)]
    c = spark.createDataFrame([("f", "c0", 1, 40, 7)], "file string, chunk_id string, start_line int, end_line int, line int")
    p = spark.createDataFrame([(1, "f", 3, "z", 1)], "point_id bigint, file string, line int, chunk_id string, start_line int")
    assert [tuple(x) for x in search.covering_chunk(p, c).collect()] == [(1, "c0", True)]
    i = spark.createDataFrame([("f", "os", 1, "r", "x")], "file string, target string, line int, repo string, part string")
    assert graph.importers(i, spark.createDataFrame([("os", 1)], "part string, line int")).count() == 1
    g = spark.createDataFrame([(1, 10, 5)], "case_id bigint, id bigint, rank0 int")
    assert evaluation.case_metrics(g, spark.createDataFrame([(1, 10, 1, 2)], "case_id bigint, id bigint, rank0 int, wanted int")).first().recall == 1.0


def test_empty_tables(spark):
    e = lambda s: spark.createDataFrame([], s)
    assert ingest.window_chunks(e("file string, text string")).count() == 0
    assert search.merge_ranges(e("file string, start_line int, end_line int, last_line int")).count() == 0
    assert search.nearest(e("id bigint, embedding array<float>"), e("query_id bigint, embedding array<float>"), 3).count() == 0
    assert S.debounce(e("event_id bigint, k string, ts timestamp_ntz"), "k").count() == 0
    assert S.sessions(e("event_id bigint, k string, ts timestamp_ntz"), "k", 5).count() == 0
    assert graph.multi_hop(e("src_id string, dst_id string, kind string, weight double"), e("seed string, id string"), 2).count() == 0
    assert evaluation.case_metrics(e("case_id bigint, id bigint"), e("case_id bigint, id bigint, rank0 int")).count() == 0


def test_islands_do_not_depend_on_partitions(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice("aab"), rng.randint(0, 400)) for i in range(300)]
    want, last, n = {}, {}, 0
    for i, k, s in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if k not in last or s - last[k] >= 5:
            n += 1
        last[k] = s
        want[i] = n
    got = {r.event_id: r.island for r in S.islands(ev(spark, *rows), "k", 5).collect()}
    back = {}
    for i, x in got.items():
        back.setdefault(x, set()).add(want[i])
    assert all(len(v) == 1 for v in back.values()) and len(back) == n


def test_storm_pauses(spark):
    got = sorted(r.event_id for r in S.storm_pauses(ev(spark, (1, "a", 0), (2, "a", 1), (3, "a", 2), (4, "a", 3), (5, "a", 11), (6, "a", 11), (7, "a", 12)), 2, 3, 8).collect())
    assert got == [3, 7]


def test_versioned_table(spark, tmp_path):
    from lodestone.sources.store import VersionedTable, read_suite

    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    first = t.write(spark.range(3))
    t.write(spark.range(5))
    assert t.read().count() == 5 and t.read(first).count() == 3 and t.read("none") is None
    (tmp_path / "s.json").write_text('[{"id": "a", "query": "q", "must_cite": ["x.py"]}, {"id": "b"}]')
    assert {r.id: (r.must_cite, r.tags) for r in read_suite(spark, str(tmp_path / "s.json")).collect()} == {"a": (["x.py"], []), "b": ([], [])}


def test_tools_always_answer(spark, data):
    from lodestone.tools import dispatch, memo_key

    memo = {}
    assert dispatch(spark, data, "nope", "{}", memo).startswith("error")
    assert dispatch(spark, data, "grep", "not json").startswith("error")
    assert "limit" in dispatch(spark, data, "grep", '{"pattern": "limit"}', memo)
    assert memo_key("a", '{"y": 1, "x": 2}') == memo_key("a", '{"x": 2, "y": 1}') and len(memo) == 2


def test_retrieve_within_budget(spark):
    from lodestone.operators.retrieve import retrieve

    c = spark.createDataFrame([(i, f"src/f{i}.py", "load_graph" if i == 3 else None, f"text about graph number {i} " * 5) for i in range(8)] + [(9, None, None, None), (10, "e", None, "")], "id bigint, file string, symbol string, text string")
    q = spark.createDataFrame([(1, "load_graph number"), (2, ""), (3, None)], "query_id bigint, query string")
    got = retrieve(q, c, budget=100).collect()
    assert {r.query_id for r in got} == {1} and max(r.used for r in got) <= 100 and min(got, key=lambda r: r.pos).id == 3


EXTRACTED = [
    ("c", "static int count_rows(struct table *t) {", "count_rows", "function"), ("cpp", "class Shard : public Base {", "Shard", "class"), ("csharp", "public abstract class Store {", "Store", "class"),
    ("kotlin", "interface Source {", "Source", "interface"), ("tsx", "export const View = (p) => {", "View", "const"), ("jsx", "function App() {", "App", "function"), ("javascript", "let run = async function () {", "run", "const"),
]
IMPORTED = [
    ("c", "#include <stdio.h>", ["stdio.h"]), ("cpp", '# include "a/b.hpp"', ["a/b.hpp"]), ("csharp", "using System.Text;", ["System.Text"]), ("kotlin", "import a.b.C", ["a.b.C"]), ("tsx", "import { a } from './b';", ["./b"]),
    ("go", 'import "fmt"', ["fmt"]), ("python", "import os, re as r", ["os", "re"]),
]


def test_extraction_in_every_language(spark):
    schema = "file string, language string, line int, line_text string"
    rows = [(f"f{i}", la, 1, t) for i, (la, t, _, _) in enumerate(EXTRACTED)] + [("n", "c", 1, None), ("n", "c", 2, "")]
    got = {(r.file, r.symbol, r.kind) for r in ingest.definitions(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(f"f{i}", s, k) for i, (_, _, s, k) in enumerate(EXTRACTED)}
    rows = [(f"f{i}", la, 1, t) for i, (la, t, _) in enumerate(IMPORTED)]
    go = ["package a", "import (", '\t"fmt"', '\tx "net/http"', ")", 'var s = "no"', "func f() {}"]
    rows += [("g", "go", i + 1, t) for i, t in enumerate(go)] + [("h", "go", 1, 'import ("a"; "b")'), ("h", "go", 2, 'var z = "no"')]
    got = {(r.file, r.target) for r in ingest.imports(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(f"f{i}", t) for i, (_, _, ts) in enumerate(IMPORTED) for t in ts} | {("g", "fmt"), ("g", "net/http"), ("h", "a"), ("h", "b")}
    rows = [("t", "tsx", 1, "class A extends B {"), ("p", "python", 1, "class C(D, E):"), ("j", "java", 1, "public class F extends G {")]
    got = {(r.child, r.parent) for r in ingest.inheritance(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("A", "B"), ("C", "D"), ("C", "E"), ("F", "G")}


def test_fenced_blocks_that_parse(spark, tmp_path):
    from lodestone.plans.composites import fenced_python_check

    rows = [(1, "```python\nx = 1\n```\n```python\ndef (\n```\n```js\n(\n```"), (2, "none"), (3, None), (4, "")]
    spark.createDataFrame([(i, t, "en", "s", 1, "t", None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, title string, created_at timestamp_ntz").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id, r.parses) for r in fenced_python_check(spark, str(tmp_path)).collect()) == [(1, False), (1, True)]


def test_variants_of_a_query(spark):
    a = rules.analyse(spark.createDataFrame([(1, "how does load_graph work in parse_tree"), (2, ""), (3, None)], "query_id bigint, query string"))
    got = {}
    for r in rules.variants(a).collect():
        got.setdefault(r.query_id, {})[r.variant] = r.text
    assert "how does load_graph work in parse_tree" in got[1].values() and len(set(got[1].values())) == len(got[1]) >= 2
    assert all(isinstance(v, str) for x in got.values() for v in x.values())


def test_call_graph_adds_callers_once(spark):
    from lodestone.operators.retrieve import expand_with_graph

    chunks = spark.createDataFrame([(1, "a.py", "load", 1, 10, 5), (2, "b.py", "use", 1, 10, 7), (3, "c.py", None, 1, 10, 9)], "id bigint, file string, symbol string, start_line int, end_line int, tokens bigint")
    ranked = spark.createDataFrame([(1, 1, 0, 0.9)], "query_id bigint, id bigint, rank0 int, score double")
    refs = spark.createDataFrame([("load", "b.py", 3), ("load", "b.py", 4), ("load", "c.py", 2), ("load", "a.py", 5), (None, "c.py", 1)], "symbol string, file string, line int")
    defs = spark.createDataFrame([("load", "a.py", "function", 1)], "symbol string, file string, kind string, start_line int")
    got = {(r.id, r.via, r.tokens) for r in expand_with_graph(ranked, chunks, refs, defs).collect()}
    assert got == {(2, "load", 7), (3, "load", 9)}
    assert {r.id for r in expand_with_graph(ranked, chunks, refs, defs, budget=8).collect()} == {2}
