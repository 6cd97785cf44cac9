"""Queries that do the whole job: cases that a cut of rows, seeds or texts would lose."""

import pyspark.sql.functions as F

from lodestone.operators import hierarchy
from lodestone.plans import composites, graphs, streams
from tools.compare import compare, duck


def test_every_document_is_wanted(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    spark.createDataFrame([(1,)], "item_id bigint").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(1,), (241,), (961,), (2401,), (2,)], "doc_id bigint").write.parquet(f"{root}/documents.parquet")
    cited = spark.createDataFrame([(1, 2401, 0), (1, 2, 1)], "query_id bigint, id bigint, rank0 int")
    monkeypatch.setattr(streams, "Lexical", lambda *_: type("L", (), {"search": lambda *_: cited})())
    monkeypatch.setattr(streams, "queries", lambda *_: None)
    got = streams.cases(spark, root).select("case_id", F.col("recall"), "rr", "passed").collect()
    assert [tuple(r) for r in got] == [(1, 0.25, 1.0, True)]


def test_hops_start_from_every_file(spark, tmp_path):
    root = str(tmp_path)
    n = [("file:r/src/a.py", "File", "a", "r/src/a.py"), ("file:r/lib/b.py", "File", "b", "r/lib/b.py"), ("sym:x", "Symbol", "x", "r/lib/b.py")]
    spark.createDataFrame([(*r, 1, "r", None, None) for r in n], "id string, kind string, name string, file string, line int, repo string, created_at timestamp_ntz, removed_at timestamp_ntz").write.parquet(f"{root}/nodes.parquet")
    e = [(1, "file:r/src/a.py", "sym:x", "DEFINES", 1, 1.0), (2, "file:r/lib/b.py", "sym:x", "DEFINES", 1, 2.0), (3, "sym:x", "sym:y", "CALLS", 1, 0.5)]
    spark.createDataFrame(e, "edge_id bigint, src_id string, dst_id string, kind string, line int, weight double").write.parquet(f"{root}/edges.parquet")
    one = {("file:r/src/a.py", "sym:x", 1, 1.0), ("file:r/lib/b.py", "sym:x", 1, 2.0)}
    assert {tuple(r) for r in graphs.multi_hop_1(spark, root).collect()} == one
    assert {tuple(r) for r in graphs.multi_hop_2(spark, root).collect()} == one | {("file:r/src/a.py", "sym:y", 2, 1.5), ("file:r/lib/b.py", "sym:y", 2, 2.5)}


def test_sections_by_the_whole_text(spark, tmp_path):
    rows = [(i, t, "en", "s", 1, "t", None) for i, t in ((1, "x" * 60 + " How does it work"), (2, "plain"), (3, None))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, title string, created_at timestamp_ntz").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.query_id: r.sections for r in composites.seed_sections(spark, str(tmp_path)).collect()}
    assert got == {1: ["map", "retrieval"], 2: ["retrieval"], 3: ["retrieval"]}


LINKS = [("b", "a"), ("c", "b"), ("e", "e"), ("f", "e"), ("g", "h"), ("h", "j"), ("j", "g"), ("i", "h"), ("z", "i")]


def test_back_edges_do_not_depend_on_the_size(spark):
    df = spark.createDataFrame(LINKS, "child string, parent string")
    for most in (100_000, 0):
        h = hierarchy.build_hierarchy(df, co_locate=most).where("back_edge_to is not null")
        assert {(r.node_id, r.back_edge_to) for r in h.collect()} == {("e", "e"), ("j", "g")}


def test_all_descendants_with_their_distance(spark):
    up, want = dict(LINKS), set()
    for x in up:
        at, n = up[x], 1
        while at is not None and n <= len(up):
            if at != x and not any(w[:2] == (at, x) for w in want):
                want.add((at, x, n))
            at, n = up.get(at), n + 1
    got = hierarchy.descendant_pairs(spark.createDataFrame(LINKS, "child string, parent string"))
    assert {tuple(r) for r in got.collect()} == want


def _callees(spark, tmp_path, refs, defs, chunks):
    """Tables of callees_join; parquet files that DuckDB finds as well."""
    for name, rows, kind in (
        ("refs", refs, "ref_id bigint, symbol string, file string, line int, repo string"),
        ("definitions", defs, "symbol string, file string, kind string, start_line int"),
        ("store_meta", [(c, None, f, None, None, None, a, b, None, None, None) for c, f, a, b in chunks], "chunk_id string, doc string, file string, filename string, repo string, language string, start_line int, end_line int, symbol string, chunk_type string, hash string"),
    ):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_links_to_callees_with_odd_rows(spark, tmp_path):
    # c3 lies in two files, the ids 4 and 5 are of several rows, c6 ends before it starts; names, kinds, lines and files are missing or empty
    refs = [(1, "f", "a", 1, "r"), (2, "f", "a", 2, "r"), (3, "f", "b", 5, "r"), (4, "g", "a", 1, "r"), (4, "f", "c", 1, "r"), (5, "own", "a", 3, "r"), (5, "own", "a", 3, None), (6, None, "a", 1, "r"), (7, "f", None, 1, "r"), (8, "f", "a", None, "r"), (9, "f", "", 1, "r"), (10, "", "b", 5, "r"), (11, "F", "b", 5, "r")]
    defs = [("f", "a", "def", 1), ("f", "a", "def", 1), ("f", "a", "def", 9), ("f", "b", "def", 1), ("f", "b", "class", None), ("f", "d", None, None), ("f", "d", None, 3), ("f", None, "def", 4), ("f", "", "def", 1), (None, "b", "def", 1), ("own", "a", "def", 1), ("g", "", "class", 1), ("", "z", "def", 1)]
    chunks = [("c1", "a", 1, 9), ("c1", "a", 1, 9), ("c2", "a", 2, 3), ("c3", "a", 1, 2), ("c3", "b", 1, 9), ("c4", "b", 5, 5), ("c5", "c", 1, 1), ("c6", "a", 3, 1), (None, "b", 1, 9), ("c7", None, 1, 9), ("c8", "a", None, 9), ("c9", "a", 1, None), ("c10", "", 1, 1)]
    root = _callees(spark, tmp_path, refs, defs, chunks)
    said = compare(spark, duck(root), root, "callees_join", graphs.callees_join, graphs.R.sql["callees_join"])
    assert said.startswith("ok "), said


def _most_rows(plan):
    """The most rows that any step of a plan gave out."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(_most_rows, below)])


def test_links_of_a_hot_symbol_are_not_listed(spark, tmp_path):
    n = 1000
    root = _callees(spark, tmp_path, [(i, "f", f"a{i}", 1, "r") for i in range(n)], [("f", f"a{i}", "def", 1) for i in range(n)], [(f"c{i}", f"a{i}", 1, 1) for i in range(n)])
    df = graphs.callees_join(spark, root)
    assert [tuple(r) for r in df.collect()] == [("f", "def", n * (n - 1))]
    assert n <= _most_rows(df._jdf.queryExecution().executedPlan()) <= 10 * n
