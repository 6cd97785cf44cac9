"""Sentences, leaks, packing and neighbours on small cases and against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import leaks as L
from lodestone.llm import neighbours as N
from lodestone.llm import packing as P
from lodestone.llm.sentences import sentence_rows, sentences


def cut(text):
    return [text[a:b] for a, b in sentences(text)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("# A head. With marks\n\nOne. Two!", ["A head. With marks", "One.", "Two!"]),
        ("Use e.g. the cache. See fig. 3 of no. 7.", ["Use e.g. the cache.", "See fig. 3 of no. 7."]),
        ("It stores ids, etc. The index is old.", ["It stores ids, etc.", "The index is old."]),
        ("Dr. Index came at 9 a.m. and left.", ["Dr. Index came at 9 a.m. and left."]),
        ('"It fails at once!" was the only note. Next.', ['"It fails at once!" was the only note.', "Next."]),
        ("The lock (a eager one. Really!) lives here. So", ["The lock (a eager one. Really!) lives here.", "So"]),
        ("A line\nbreak is none.\n\nA blank is", ["A line\nbreak is none.", "A blank is"]),
        ("- One. Two.\n- Three\n1. Four.", ["One.", "Two.", "Three", "Four."]),
        ("Before.\n```\ncode. More.\n```\nAfter.", ["Before.", "After."]),
        ("```\nnever closed. x", []),
        ("Call `a.b. C` or app/x.py. Version v1.2 is out.", ["Call `a.b. C` or app/x.py.", "Version v1.2 is out."]),
        ("Das gilt z. B. für den Baum. Am 3. Mai war es so. Siehe usw. Danach", ["Das gilt z. B. für den Baum.", "Am 3. Mai war es so.", "Siehe usw.", "Danach"]),
        ("« Rien ne marche ! » disait-il. Voir p. ex. la fig. 12.", ["« Rien ne marche ! » disait-il.", "Voir p. ex. la fig. 12."]),
        ("¿Depende de esto? ¡No borres! El Sr. Ruiz salió.", ["¿Depende de esto?", "¡No borres!", "El Sr. Ruiz salió."]),
        ("为什么这么慢？请不要删除！日志里写着“找不到。请重试”，没有别的。", ["为什么这么慢？", "请不要删除！", "日志里写着“找不到。请重试”，没有别的。"]),
        ("ログには「ない。後で」と書かれた。次。", ["ログには「ない。後で」と書かれた。", "次。"]),
        ("अब तालिका खाली है। डॉ. सूचक आए।", ["अब तालिका खाली है।", "डॉ. सूचक आए।"]),
        ("รุ่น v2.19 ใหม่ ทำไมช้า", ["รุ่น v2.19 ใหม่", "ทำไมช้า"]),
        ("This works... but only if. Wait... Then", ["This works... but only if.", "Wait...", "Then"]),
        ("on the header.Keep v. 4 here", ["on the header.", "Keep v. 4 here"]),
        ("we wait. some lower start.", ["we wait.", "some lower start."]),
        ("", []), ("   \n\n ", []), ("***", []), ("…", []),
    ],
)
def test_sentences(text, want):
    assert cut(text) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1 .!?…\n\"'“”«»()`#-*。「」ก है।:/", max_size=80))
def test_spans_are_in_order_and_trimmed(text):
    last = 0
    for a, b in sentences(text):
        assert last <= a < b <= len(text) and text[a:b] == text[a:b].strip()
        last = b


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "x"), (1, "A b. C d.", "x"), (2, None, "x"), (3, "", "x"), (4, "x " * 200_000 + "end. Next.", "x")], "doc_id bigint, text string, start_pos string")
    got = {tuple(r) for r in sentence_rows(df).distinct().collect()}
    assert {(1, 0, 4), (1, 5, 9), (4, 0, 400_004), (4, 400_005, 400_010)} == got


HEAD = "Write a function that solves the puzzle below and returns one value. "
S1, S2, S3 = "The clock mender of the stable labels one jagged basket for each amber pebble left behind before supper.", "Count the ways to hang 90 tangled pebbles above the boathouse so that no glass blower sees it twice.", "Whenever a raft is mossy the sail weaver trades it for 91 mirrorballs and a crooked violin at dawn."
ITEMS = [(1, HEAD + S1 + " " + S2), (2, HEAD + S3 + " " + "A brittle map printer paints 82 mossy barrels near the tollgate before supper every single day of May.")]


def leaked(*texts):
    return set(L.Shard(L.TestSet(ITEMS), list(texts)).search())


def test_leaks():
    fill = "Some other words about caches come first. "
    assert leaked(fill + S1 + " " + S2 + " The end.", fill + S1, HEAD, fill, "", S2 + " " + S1) == {(0, 1)}
    # layout, case, markup, look-alikes, invisible characters
    odd = S1.upper().replace("CLOCK", "**CLOCK**") + "\n> " + S2.replace("hang", "ha\u200bng").replace("o", "о").replace(" above", "\nabove")
    assert leaked(odd) == {(0, 1)}
    words = (S1 + " " + S2).split()
    some = [w if i % 7 else "changed" for i, w in enumerate(words)]
    many = [w if i % 3 else "changed" for i, w in enumerate(words)]
    assert leaked(" ".join(some)) == {(0, 1)} and leaked(" ".join(many)) == set()
    added = " ".join(w + (" extra" if i % 8 == 0 else "") for i, w in enumerate(words))
    assert leaked(added) == {(0, 1)}


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_filter_before_alignment_loses_nothing(data):
    words = (S1 + " " + S2).split()
    n = len(L.plain_words(S1 + " " + S2))
    cut = len(S1.split())
    for i in data.draw(st.lists(st.integers(0, len(words) - 1), max_size=int(0.2 * n), unique=True).filter(lambda x: all(sum(lo <= i < hi for i in x) <= L.MOST_IN_ONE * (hi - lo) for lo, hi in ((0, cut), (cut, len(words)))))):
        words[i] = "zzz"
    assert leaked("Before it. " + " ".join(words) + " After it.") == {(0, 1)}


def test_long_and_repetitive_texts_are_searched_in_stretches():
    rows = [" ".join([S1.rsplit(" ", 3)[0]] * 300 + [S1, S2] + [S2.split(" ", 4)[4]] * 300), S1 + " " + S2, "count the ways to hang " * 4000]
    tests = L.TestSet(ITEMS)
    assert set(L.Shard(tests, rows).search()) == set(L.Shard(tests, rows).search(most_hits=500)) == {(0, 1), (1, 1)}


def test_longest_verbatim_match_and_its_place():
    words = (S1 + " " + S2).split()
    words[5] = "zzz"
    fill = "Some other words come first. "
    got = list(L.Shard(L.TestSet(ITEMS), [fill, fill + " ".join(words), S1 + " " + S2]).locations())
    n = len(L.plain_words(S1 + " " + S2))
    assert sorted(got) == [(1, 1, 5 + 6, n - 6), (2, 1, 0, n)]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 36), max_size=6, unique=True))
def test_longest_match_against_brute_force(changed):
    want = L.plain_words(S1 + " " + S2)
    words = (S1 + " " + S2).split()
    for i in changed:
        if i < len(words):
            words[i] = "zzz"
    doc = L.plain_words(" ".join(words))
    best = max((next((k for k in range(len(doc) - i) if i + k >= len(doc) or j + k >= len(want) or doc[i + k] != want[j + k]), min(len(doc) - i, len(want) - j)), -i) for i in range(len(doc)) for j in range(len(want)))
    for d, item, at, n in L.Shard(L.TestSet(ITEMS), [" ".join(words)]).locations():
        assert (n, -at) == best


def test_clean_documents(spark):
    docs = spark.createDataFrame([(1, S1 + " " + S2), (2, "Plain."), (3, None), (3, None)], "doc_id bigint, text string")
    leaks = L.find_leaks(docs, spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    assert sorted(r.doc_id for r in L.without_leaks(docs, leaks).collect()) == [2, 3, 3]


def test_find_leaks_in_blocks(spark):
    docs = spark.createDataFrame([(1, S1 + " " + S2), (2, S1 + " " + S2), (2, S1 + " " + S2), (3, None), (4, "")], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert {tuple(r) for r in L.find_leaks(docs, items, block=1).collect()} == {(1, 1), (2, 1)}
    assert L.find_leaks(docs, items.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 50), st.integers(1, 30), max_size=12), st.integers(1, 9))
def test_plans_hold_every_item_once_within_every_capacity(histogram, most):
    rows, bins = P.plan_bins(histogram, 50, most)
    load, count = [0] * bins, [0] * bins
    seen = {}
    for size, lo, hi, first, per in rows:
        for r in range(lo, hi):
            b = first + (r - lo) // per
            load[b] += size
            count[b] += 1
            seen.setdefault(size, set()).add(r)
    assert all(x <= 50 for x in load) and all(x <= most for x in count) and all(x > 0 for x in count)
    assert {k: set(range(n)) for k, n in histogram.items()} == seen


def test_attention_cost_binds():
    # 512 texts of one token: tokens and texts would let all into one container, 256 tiles fill its attention cost
    rows, bins = P.plan_bins({1: 512}, 512)
    assert bins == 2 and P.plan_bins({1: 512}, 512, tile=1)[1] == 1
    with pytest.raises(ValueError):
        P.plan_bins({1: 64}, 512, most_cost=1000)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 50), st.integers(1, 30), max_size=10))
def test_every_capacity_holds(histogram):
    rows, bins = P.plan_bins(histogram, 50, 9, tile=8)
    cost = [0] * bins
    for size, lo, hi, first, per in rows:
        for r in range(lo, hi):
            cost[first + (r - lo) // per] += P.attention_cost(size, 8)
    assert all(c <= P.attention_cost(50, 8) for c in cost)


def test_pack(spark):
    rng = np.random.default_rng(3)
    sizes = [(i, int(x)) for i, x in enumerate(rng.integers(0, 260, 800))] + [(900, 1000)]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint").repartition(5)
    cont = spark.createDataFrame([("s", 256), ("b", 4000), ("bad", 0), (None, 9)], "container string, capacity_tokens int")
    got = P.pack(df, cont).toPandas()
    for c, cap in (("s", 256), ("b", 4000)):
        g = got[got["container"] == c]
        assert g.groupby("bin")["tokens"].sum().max() <= cap and sorted(set(g["doc_id"])) == sorted(i for i, _ in sizes)
        assert dict(g.groupby("doc_id")["tokens"].sum()) == dict(sizes)
        assert set(g["bin"]) == set(range(g["bin"].max() + 1))
        assert g["tokens"].sum() / (g["bin"].nunique() * cap) > 0.97
    assert len(got[(got["container"] == "s") & (got["doc_id"] == 900)]) == 4
    assert set(got["container"]) == {"s", "b"}
    assert P.pack(df.limit(0), cont).count() == 0 and P.pack(df, cont.limit(0)).count() == 0


def test_sizes_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in P.token_sizes(df).collect()) == [(1, 2), (3, 0)]


def brute(rows, top=5, least=0.9):
    ids = np.array([i for i, _ in rows])
    x = np.array([e for _, e in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = set()
    for k in range(len(ids)):
        s[k, k] = -9
        o = [j for j in np.lexsort((ids, -s[k])) if s[k, j] >= least][:top]
        out |= {(min(ids[k], ids[j]), max(ids[k], ids[j])) for j in o}
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 64))
    rows = [(i, (centres[i % 12 if i % 3 else 0] + 0.25 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # a hot vector
    dirty = [(2000, None), (2001, [0.0] * 64), (2002, [1.0] * 63), (2003, [float("nan")] + [1.0] * 63), rows[3], (None, rows[5][1]), (2004, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame(rows + dirty, "vec_id bigint, embedding array<float>")
    got = {(r.vec_a, r.vec_b) for r in N.similar_pairs(df, leaf=64, sample=200).collect()}
    want = brute(rows)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(got)


def test_ties_take_the_smaller_ids(spark):
    v = [1.0] + [0.0] * 63
    df = spark.createDataFrame([(i, v) for i in (9, 3, 5, 1, 7, 8, 2)], "vec_id bigint, embedding array<float>")
    assert {tuple(r) for r in N.similar_pairs(df).collect()} == brute([(i, v) for i in (9, 3, 5, 1, 7, 8, 2)])


def test_few_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert N.similar_pairs(empty).count() == 0
    assert N.similar_pairs(spark.createDataFrame([(1, [1.0] * 64)], "vec_id bigint, embedding array<float>")).count() == 0


def test_greedy_search_over_the_graph(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 64)).astype(np.float32)
    packed = N.pack(spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id bigint, embedding array<float>"))
    index = N.build_index(packed, leaf=64, sample=200)
    q = N.pack(spark.createDataFrame([(i, (x[i * 7] + 0.05 * rng.normal(size=64)).tolist()) for i in range(20)], "vec_id bigint, embedding array<float>")).withColumnRenamed("vec_id", "query_id")
    best = {r.query_id: r.vec_id for r in N.search(index, q, top=1).collect()}
    assert sum(best[i] == i * 7 for i in range(20)) >= 18


def _index_recall(spark, n=300, **options):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 8)) @ rng.normal(size=(8, 64))
    packed = N.pack(spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x.astype(np.float32))], "vec_id bigint, embedding array<float>"))
    graph = {(r.a, r.b) for r in N.build_index(packed, k=10, settled=0.02, **options).graph.collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(n) for j in np.argsort(-s[i])[:10]}
    return len(graph & want) / len(want)


def test_large_leaves_are_split_by_the_data(spark):
    assert _index_recall(spark, leaf=500, largest=60, sample=4) >= 0.9


def test_hubs_are_joined_in_all_pairs_of_parts(spark):
    # parts of four members: a graph whose hubs lost candidates would stop far lower
    assert _index_recall(spark, n=120, leaf=16, sample=500, chunk=12) >= 0.9


def test_a_hub_in_parts_gives_what_it_gives_whole():
    import pandas as pd

    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 64)).astype(np.float32)
    given = pd.DataFrame({"id": range(30), "home": 1, "worst": -2.0, "last": 0, "v": [e.tobytes() for e in x]})
    whole = pd.DataFrame({"centre": 99, "unit": 0, "part": 0, "b": range(30), "fresh": 1})
    part = np.arange(30) % 3
    rows = [(99, min(p, o) * 3 + max(p, o), p, b, 1) for b, p in enumerate(part) for o in range(3)]
    parts = pd.DataFrame(rows, columns=["centre", "unit", "part", "b", "fresh"])
    one, two = N._join_locally(whole, given, 30), N._join_locally(parts, given, 30)
    assert {tuple(r) for r in one[["a", "b"]].to_numpy()} == {tuple(r) for r in two[["a", "b"]].to_numpy()} and len(one) == 30 * 29
