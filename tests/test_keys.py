"""Orphan references and hierarchies on small cases."""

from datetime import datetime as D

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.operators import hierarchy as H
from lodestone.operators import orphans as O

T = [D(2024, m, 1) for m in range(1, 13)]
REF = "src_table string, row_id bigint, key string, seen_at timestamp_ntz"
TARGET = "key string, created_at timestamp_ntz, removed_at timestamp_ntz"


def orphans(spark, refs, targets):
    r = spark.createDataFrame([("t", *x) for x in refs], REF)
    return {(x.row_id, x.reason) for x in O.find_orphans(r, spark.createDataFrame(targets, TARGET)).collect()}


def test_reasons(spark):
    targets = [("a", T[1], T[3]), ("a", T[5], None), ("b", T[8], None), ("c", T[1], T[2]), ("c", T[1], T[2])]
    refs = [(1, "a", T[2]), (2, "a", T[4]), (3, "a", T[6]), (4, "b", T[2]), (5, "c", T[2]), (6, "z", T[2]), (7, None, T[2]), (8, "a", T[3]), (9, "", T[1])]
    assert orphans(spark, refs, targets) == {(2, "late"), (4, "late"), (5, "deleted"), (6, "missing"), (8, "late"), (9, "missing")}


def test_empty_sides(spark):
    assert orphans(spark, [(1, "a", T[0])], []) == {(1, "missing")}
    assert orphans(spark, [], [("a", T[0], None)]) == set()


def test_unusable_spans_and_unknown_times(spark):
    targets = [("a", T[5], T[3]), ("b", None, None), ("c", T[1], None)]
    assert orphans(spark, [(1, "a", T[4]), (2, "b", T[4]), (3, "c", None)], targets) == {(1, "late"), (2, "deleted"), (3, "deleted")}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 11), st.one_of(st.none(), st.integers(0, 11))), max_size=12), st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 11)), max_size=12))
def test_against_brute_force(spark, targets, refs):
    ts = [(k, T[a], None if b is None else T[b]) for k, a, b in targets]
    want = set()
    for i, (k, s) in enumerate(refs):
        own = [(a, b) for q, a, b in ts if q == k]
        if any(a <= T[s] and (b is None or T[s] < b) for a, b in own):
            continue
        want.add((i, "missing" if not own else "late" if any(a > T[s] for a, _ in own) else "deleted"))
    assert orphans(spark, [(i, k, T[s]) for i, (k, s) in enumerate(refs)], ts) == want


def test_cleaning(spark):
    df = spark.createDataFrame([("  a\\b\t",), (None,), ("A",)], "c string")
    assert [r[0] for r in df.select(O.clean_edge_id(df["c"])).collect()] == ["a/b", None, "A"]


def test_cascade_is_a_fixpoint_and_survives_cycles(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("a", "d"), ("x", "y"), ("b", "a"), (None, "a"), ("e", None)], "child string, parent string")
    got = {(r.id, r.level) for r in O.orphan_cascade(links, spark.createDataFrame([("a",), ("a",)], "id string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert O.orphan_cascade(links, spark.createDataFrame([], "id string")).count() == 0


def test_levels_tell_direct_from_inherited(spark):
    rows = [("edges", 1, T[1], "a", "gone"), ("edges", 2, T[1], "b", "a"), ("refs", 1, T[1], "file:f", "b"), ("imports", 1, T[1], "file:g", "m"), ("edges", 3, T[1], None, "b"), ("edges", 4, T[1], "a", "b")]
    links = spark.createDataFrame(rows, "src_table string, row_id bigint, seen_at timestamp_ntz, owner string, record string")
    found = spark.createDataFrame([("edges", 1, T[1], "missing")], "src_table string, row_id bigint, seen_at timestamp_ntz, reason string")
    got = {(r.src_table, r.row_id, r.reason, r.level) for r in O.orphan_levels(links, found).collect()}
    assert got == {("edges", 1, "missing", 0), ("edges", 2, "inherited", 1), ("refs", 1, "inherited", 2), ("edges", 3, "inherited", 2), ("edges", 4, "inherited", 2)}


LINKS = [("b", "a"), ("c", "b"), ("d", "b"), ("e", "e"), ("f", "e"), ("g", "h"), ("h", "g"), ("i", "h"), ("c", "b"), (None, "a"), ("z", None), ("k", "m"), ("k", "l")]
WANT = {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 2), ("e", "CYCLE", -1), ("f", "CYCLE", -1), ("g", "CYCLE", -1), ("h", "CYCLE", -1), ("i", "CYCLE", -1), ("l", "l", 0), ("k", "l", 1), ("m", "m", 0)}


def _rows(df):
    return {(r.node_id, r.root_id, r.depth) for r in df.collect()}


def test_hierarchy_both_ways(spark):
    df = spark.createDataFrame(LINKS, "child string, parent string")
    assert _rows(H.build_hierarchy(df)) == WANT
    # with nothing co-located, pointer doubling must give the same
    assert _rows(H.build_hierarchy(df, co_locate=0)) == WANT


def test_long_chain(spark):
    n = 300
    df = spark.createDataFrame([(f"n{i + 1:04d}", f"n{i:04d}") for i in range(n)], "child string, parent string")
    want = {(f"n{i:04d}", "n0000", i) for i in range(n + 1)}
    assert _rows(H.build_hierarchy(df)) == want
    assert _rows(H.build_hierarchy(df, co_locate=10)) == want
    pairs = H.descendant_pairs(df, co_locate=10)
    assert pairs.count() == n * (n + 1) // 2


def test_paths_and_descendants(spark):
    got = {r.node_id: (r.path, r.descendants) for r in H.node_paths(spark.createDataFrame(LINKS, "child string, parent string")).collect()}
    assert got["c"] == ("a > b > c", 0) and got["a"] == ("a", 3) and got["g"][0] is None and got["k"] == ("l > k", 0)


def test_no_links(spark):
    assert H.build_hierarchy(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_every_parent_keeps_its_row(spark):
    got = _rows(H.build_hierarchy(spark.createDataFrame([("m", "p1"), ("m", "p2"), ("p2", "q")], "child string, parent string")))
    assert got == {("m", "p1", 1), ("p1", "p1", 0), ("p2", "q", 1), ("q", "q", 0)}


def _brute(links):
    """node -> root, depth, line, back edge."""
    up = {}
    for c, p in links:
        up[c] = min(p, up.get(c, p))
    out = {}
    for x in {i for link in links for i in link}:
        line, at = [], up.get(x)
        while at is not None and at not in line and at != x:
            line.append(at)
            at = up.get(at)
        if at is None:
            out[x] = (line[-1] if line else x, len(line), line, None)
            continue
        ring, at = [], at
        while at not in ring:
            ring.append(at)
            at = up[at]
        out[x] = ("CYCLE", -1, line, min(ring) if x in ring and up[x] == min(ring) else None)
    return out


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=14))
def test_hierarchies_against_brute_force(spark, links):
    links = [(f"n{a:02d}", f"n{b:02d}") for a, b in links]
    df = spark.createDataFrame(links, "child string, parent string")
    for most in (100_000, 0):
        h = H.build_hierarchy(df, co_locate=most, lines=True)
        assert {r.node_id: (r.root_id, r.depth, list(r.line), r.back_edge_to) for r in h.collect()} == _brute(links)
