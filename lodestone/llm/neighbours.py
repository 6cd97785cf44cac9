"""The k most similar vectors for every vector: NN-descent over Spark joins.

1. Exact copies form classes (128 bits of hash over the components); only class representatives enter the graph, so a hot
   vector that a third of all rows hold is one node.
2. Random-projection trees are fitted on a bounded sample (``sample`` rows) and give every vector one leaf per tree. A leaf
   that turns out larger than ``largest`` is split on by the data themselves, level by level, until no leaf is, so a leaf is
   bounded whatever the number of rows. Vectors of a leaf are compared with each other: the first graph.
3. NN-descent rounds: around every node its neighbours and reverse neighbours are compared with each other, unless both
   were there before. Nodes are worked on in blocks of neighbouring leaves, and a vector is sent once to each block that needs
   it, not once to each node. A node with more than ``chunk`` neighbours both ways is worked on in parts, every part
   with itself and with every other part, so no candidate is dropped. Rounds end when fewer than ``settled`` of the neighbours
   are new; they never end silently before.
4. Members of a class take the neighbours of their representative and of each other.

``search`` answers new queries by greedy walks over the finished graph.

Defined results: a vector is usable with ``dim`` finite components that aren't all zero, others give no rows;
repeated ids count once; similarity is the cosine in doubles, rounded to nine decimals; ties go to the smaller id;
an empty or one-row table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, cut_table

_PAIRS = "a bigint, ha int, b bigint, hb int, sim double"


def usable_vectors(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(vec_id, embedding) of usable rows, one per id."""
    ok = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id is not null and embedding is not null").where(ok).dropDuplicates(["vec_id"])


def copy_classes(usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives with their vector, members vec_id -> rep); only hashes of the vectors are grouped and joined."""
    zero = F.transform("embedding", lambda x: x + F.lit(0.0).cast("float"))  # no sign on zeros
    keyed = usable.select("vec_id", F.xxhash64(zero).alias("h1"), F.xxhash64(F.lit(7), zero).alias("h2"))
    classes = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"))
    members = cut(keyed.join(classes, ["h1", "h2"]).select("vec_id", "rep"))
    return usable.join(members.where("vec_id = rep").select("vec_id"), "vec_id", "left_semi"), members


class Forest:
    """Random-projection trees of one depth: planes through the middle of two points, cut at the sample's median."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.depth, self.planes, self.cuts = depth, [], []
        for _ in range(trees):
            planes, cuts = np.zeros((2**depth, sample.shape[1])), np.zeros(2**depth)
            node = np.zeros(len(sample), dtype=np.int64)
            for level in range(depth):
                first = 2**level - 1
                for k in range(2**level):
                    own = sample[node == k]
                    if len(own) >= 2:
                        a, b = own[rng.choice(len(own), 2, replace=False)]
                        plane = a - b
                    else:
                        plane = rng.normal(size=sample.shape[1])
                    planes[first + k] = plane
                    cuts[first + k] = np.median(own @ plane) if len(own) else 0.0
                node = node * 2 + (np.einsum("ij,ij->i", sample, planes[first + node]) > cuts[first + node])
            self.planes.append(planes)
            self.cuts.append(cuts)

    def leaves(self, x: np.ndarray) -> list[np.ndarray]:
        """The leaf of every row in every tree, as a path: 1 for the root, then one binary digit a level."""
        out = []
        for planes, cuts in zip(self.planes, self.cuts):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (np.einsum("ij,ij->i", x, planes[at]) > cuts[at])
            out.append(node + 2**self.depth)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bytes_to_unit(column, n: int) -> np.ndarray:
    """Packed components of ``n`` vectors -> unit vectors in doubles."""
    return _unit(np.frombuffer(b"".join(column), dtype=np.float32).reshape(n, -1)) if n else np.zeros((0, 1))


def _arrow_to_unit(column: pa.Array) -> np.ndarray:
    return _bytes_to_unit(column.to_pylist(), len(column))


def _top(ids: np.ndarray, x: np.ndarray, k: int, most: int, seed: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k nearest inside a leaf; a leaf over ``most`` is halved at the median of a random direction first."""
    if len(ids) > most:
        rng = np.random.default_rng(seed)
        a, b = x[rng.choice(len(ids), 2, replace=False)]
        along = x @ (a - b)
        order = np.argsort(along, kind="stable")
        half = len(ids) // 2
        yield from _top(ids[order[:half]], x[order[:half]], k, most, 2 * seed)
        yield from _top(ids[order[half:]], x[order[half:]], k, most, 2 * seed + 1)
        return
    if len(ids) < 2:
        return
    s = x @ x.T
    np.fill_diagonal(s, -2.0)
    m = min(k, len(ids) - 1)
    by_id = np.argsort(ids, kind="stable")
    best = by_id[np.argsort(-np.round(s[:, by_id], 9), axis=1, kind="stable")[:, :m]]  # ties to the smaller id
    rows = np.repeat(np.arange(len(ids)), m)
    yield ids[rows], ids[best.ravel()], s[rows, best.ravel()]


def pack(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, v): the components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(1)
            flat = e.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            x = flat.reshape(len(e), -1) if len(e) else np.zeros((0, 1), dtype=np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], type=pa.binary())], names=["vec_id", "v"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, v binary")


def _split_on(placed: DataFrame, largest: int, max_levels: int = 200) -> DataFrame:
    """placed(tree, vec_id, leaf, v): leaves with more than ``largest`` rows are split, level by level, until none is left.

    A level takes two rows of each such leaf (by hash, by partial aggregation) and every row goes to the nearer one.
    """
    done: list[DataFrame] = []
    for level in range(max_levels):
        big = placed.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > largest).select("tree", "leaf")
        if not done:
            big = cut(big)
            if big.isEmpty():
                return placed
            done.append(placed.join(big, ["tree", "leaf"], "left_anti"))
            rest = cut_table(placed.join(big, ["tree", "leaf"], "left_semi"))
        h = F.xxhash64("vec_id", "tree", F.lit(level))
        pivots = rest.groupBy("tree", "leaf").agg(F.min_by("v", h).alias("p"), F.max_by("v", h).alias("q"))

        def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, p, q = (_arrow_to_unit(b.column(i)) for i in (3, 4, 5))
                side = np.einsum("ij,ij->i", x, p - q) > 0
                leaf = b.column(2).to_numpy() * 2 + side
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf), b.column(3)], names=["tree", "vec_id", "leaf", "v"])

        halves = cut_table(rest.join(pivots, ["tree", "leaf"]).select("tree", "vec_id", "leaf", "v", "p", "q").mapInArrow(halve, "tree int, vec_id bigint, leaf bigint, v binary"))
        big = cut(halves.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > largest).select("tree", "leaf"))
        if big.isEmpty():
            done.append(halves)
            break
        done.append(halves.join(big, ["tree", "leaf"], "left_anti"))
        rest = halves.join(big, ["tree", "leaf"], "left_semi")
    else:
        raise RuntimeError(f"leaves are still larger than {largest} rows after {max_levels} levels")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


class Index:
    """What a search needs: ``nodes`` (vec_id, v, home), ``graph`` (a, b, sim) and the leaves with their forest."""

    def __init__(self, nodes: DataFrame, graph: DataFrame, leaves: DataFrame | None, forest: Forest | None) -> None:
        self.nodes, self.graph, self.leaves, self.forest = nodes, graph, leaves, forest


def _place(packed: DataFrame, forest: Forest) -> DataFrame:
    given = packed.sparkSession.sparkContext.broadcast(forest)  # bounded: trees x 2^depth planes, depth by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, leaf in enumerate(given.value.leaves(_arrow_to_unit(b.column(1)))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t, dtype=np.int32)), b.column(0), pa.array(leaf), b.column(1)], names=["tree", "vec_id", "leaf", "v"])

    return packed.select("vec_id", "v").mapInArrow(run, "tree int, vec_id bigint, leaf bigint, v binary")


def _first_graph(placed: DataFrame, k: int, most: int) -> DataFrame:
    """Pairs inside the leaves; home is the block of a node: the leaf of the first tree without its last three digits."""

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        x = _bytes_to_unit(g["v"], len(g))
        parts = list(_top(g["vec_id"].to_numpy(), x, k, most))
        cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3)]
        return pd.DataFrame({"a": cols[0].astype("int64"), "b": cols[1].astype("int64"), "sim": cols[2].astype("float64")})

    return placed.groupBy("tree", "leaf").applyInPandas(compare, "a bigint, b bigint, sim double")


def _keep_best(pairs: DataFrame, k: int) -> DataFrame:
    """(a, ha, b, hb, sim, fresh) -> the k best b of every a, ties to the smaller id; a pair that was known isn't fresh.

    One shuffle: what is partitioned by a is so for (a, b) as well.
    """
    w = Window.partitionBy("a").orderBy(F.desc(F.round("sim", 9)), "b")
    one = pairs.repartition("a").groupBy("a", "b").agg(F.first("ha").alias("ha"), F.first("hb").alias("hb"), F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("a", "ha", "b", "hb", "sim", "fresh")


def _join_locally(near: pd.DataFrame, given: pd.DataFrame, k: int) -> pd.DataFrame:
    """One block: rows (centre, unit, part, b, fresh) and the vectors (id, home, worst, last, v) they name -> better pairs, both ways.

    Members of one centre are compared with each other, but for pairs that were both there before; in a unit of two parts
    only members of different parts. A pair comes out if it beats the last neighbour (worst, last) of one of the two.
    """
    none = pd.DataFrame({"a": [], "ha": [], "b": [], "hb": [], "sim": []}).astype({"a": "int64", "ha": "int32", "b": "int64", "hb": "int32", "sim": "float64"})
    if not len(near) or not len(given):
        return none
    given = given.sort_values("id", kind="stable")
    ids, worst, last, home = (given[c].to_numpy() for c in ("id", "worst", "last", "home"))
    x = _bytes_to_unit(given["v"], len(given))
    near = near.sort_values(["centre", "unit"], kind="stable")
    centre, unit, part, fresh = (near[c].to_numpy() for c in ("centre", "unit", "part", "fresh"))
    fresh = fresh.astype(bool)
    at = np.searchsorted(ids, near["b"].to_numpy())
    cuts = np.nonzero((centre[1:] != centre[:-1]) | (unit[1:] != unit[:-1]))[0] + 1
    lo, hi, sims = [], [], []
    for i, j in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(near)]])):
        new = fresh[i:j]
        if j - i < 2 or not new.any():
            continue
        m = at[i:j]
        y = x[m]
        s = y @ y.T
        r = np.round(s, 9)
        w, z, own = worst[m], last[m], ids[m]
        beats = (r > w[:, None]) | (r == w[:, None]) & (own[None, :] < z[:, None])
        ok = (beats | beats.T) & (new[:, None] | new[None, :])
        q = part[i:j]
        if q[0] != q[-1] or (q != q[0]).any():
            ok &= q[:, None] != q[None, :]
        p, q = np.nonzero(np.triu(ok, 1))
        if len(p):
            lo.append(m[p])
            hi.append(m[q])
            sims.append(s[p, q])
    if not lo:
        return none
    lo, hi, sims = np.concatenate(lo), np.concatenate(hi), np.concatenate(sims)
    a, b, s = np.concatenate([lo, hi]), np.concatenate([hi, lo]), np.concatenate([sims, sims])
    _, first = np.unique(a * np.int64(len(ids)) + b, return_index=True)
    a, b, s = a[first], b[first], s[first]
    # of what one block finds for a node, no more than k can be among its k best
    order = np.lexsort((ids[b], -np.round(s, 9), a))
    a, b, s = a[order], b[order], s[order]
    start = np.concatenate([[0], np.nonzero(a[1:] != a[:-1])[0] + 1])
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    keep = (rank < k) & (ids[a] != ids[b])
    keep &= (np.round(s, 9) > worst[a]) | (np.round(s, 9) == worst[a]) & (ids[b] < last[a])
    a, b, s = a[keep], b[keep], s[keep]
    return pd.DataFrame({"a": ids[a], "ha": home[a], "b": ids[b], "hb": home[b], "sim": s})


def _descend(graph: DataFrame, nodes: DataFrame, k: int, chunk: int) -> DataFrame:
    """One NN-descent round: candidates (a, ha, b, hb, sim), both ways, that beat the last neighbour of a."""
    end = F.max(F.struct((-F.round("sim", 9)).alias("s"), F.col("b").alias("id")))
    full = graph.groupBy(F.col("a").alias("b")).agg(end.alias("end"), F.count("*").alias("n")).where(F.col("n") >= k).select("b", (-F.col("end.s")).alias("worst"), F.col("end.id").alias("last"))
    fresh = F.col("fresh").cast("int").alias("fresh")
    both = graph.select(F.col("a").alias("centre"), F.col("ha").alias("block"), "b", fresh).unionByName(graph.select(F.col("b").alias("centre"), F.col("hb").alias("block"), F.col("a").alias("b"), fresh))
    near = both.repartition("centre").groupBy("centre", "block", "b").agg(F.max("fresh").alias("fresh"))
    near = near.withColumn("block", F.col("block").cast("bigint"))
    hubs = cut(near.groupBy("centre").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("centre", F.ceil(F.col("n") / chunk).cast("int").alias("parts")))
    if hubs.isEmpty():
        near = near.select("block", "centre", F.lit(0).alias("unit"), F.lit(0).alias("part"), "b", "fresh")
    else:
        # each part meets itself and every other part; units of hubs are blocks of their own
        j = near.join(hubs, "centre", "left")
        small = j.where("parts is null").select("block", "centre", F.lit(0).alias("unit"), F.lit(0).alias("part"), "b", "fresh")
        p = j.where("parts is not null").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        unit = (F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).alias("unit")
        p = p.select("centre", unit, "part", "b", "fresh").withColumn("block", -F.abs(F.xxhash64("centre", "unit") % F.lit(1 << 40)) - 1)
        near = small.unionByName(p.select(small.columns))
    need = near.select(F.col("block").alias("to_block"), F.col("b").alias("id")).distinct()
    full = full.withColumnRenamed("b", "id")
    known = nodes.select(F.col("vec_id").alias("id"), "v", "home").join(full, "id", "left").select("id", "v", "home", F.coalesce("worst", F.lit(-2.0)).alias("worst"), F.coalesce("last", F.lit(0)).alias("last"))
    vectors = need.join(known, "id").select("to_block", "id", "home", "worst", "last", "v")
    return near.groupBy("block").cogroup(vectors.groupBy("to_block")).applyInPandas(lambda x, y: _join_locally(x, y, k), _PAIRS)


def build_index(packed: DataFrame, k: int = 10, trees: int = 3, settled: float = 0.1, leaf: int = 512, largest: int = 8192, sample: int = 20_000, chunk: int = 512, max_rounds: int = 64) -> Index:
    """(vec_id, v) -> the graph of about the k nearest b of every a, and what a search over it needs.

    Rounds end when fewer than ``settled`` of the neighbours are new; more than ``max_rounds`` are an error.
    """
    packed = cut_table(packed)
    n = packed.count()
    if n < 2:
        return Index(packed.withColumn("home", F.lit(0)), packed.sparkSession.createDataFrame([], "a bigint, b bigint, sim double"), None, None)
    share = min(1.0, sample / n)
    rows = packed.select("v").where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * sample).collect()
    x = _bytes_to_unit([r[0] for r in rows], len(rows)) if rows else np.zeros((1, 64))
    depth = max(0, min(int(np.ceil(np.log2(max(1.0, n / leaf)))), int(np.log2(max(1, len(x) // 12)))))
    forest = Forest(x, depth, trees)
    placed = _split_on(_place(packed, forest), largest)
    own = placed.where("tree = 0").select("vec_id", F.greatest(F.lit(1), F.shiftright("leaf", 3)).cast("int").alias("home"))
    nodes = cut_table(packed.join(own, "vec_id"))
    home = nodes.select("vec_id", "home")
    first = _first_graph(placed, k, 2 * leaf).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("a").orderBy(F.desc(F.round("sim", 9)), "b")
    first = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    first = first.join(home.select(F.col("vec_id").alias("a"), F.col("home").alias("ha")), "a").join(home.select(F.col("vec_id").alias("b"), F.col("home").alias("hb")), "b")
    graph = cut_table(first.select("a", "ha", "b", "hb", "sim", F.lit(True).alias("fresh")))
    for _ in range(max_rounds):
        known = graph.withColumn("fresh", F.lit(False))
        graph = cut_table(_keep_best(known.unionByName(_descend(graph, nodes, k, chunk).withColumn("fresh", F.lit(True))), k))
        total, new = graph.agg(F.count("*"), F.count_if("fresh")).first()
        if new <= settled * total:
            return Index(nodes, graph.select("a", "b", "sim"), placed.select("tree", "leaf", "vec_id"), forest)
    raise RuntimeError(f"the graph did not settle within {max_rounds} rounds")


def similar_pairs(vectors: DataFrame, top: int = 5, least: float = 0.9, dim: int = 64, **index_options) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: similarity of at least ``least``, one among the ``top`` most similar of the other."""
    reps, members = copy_classes(usable_vectors(vectors, dim))
    graph = build_index(pack(reps), k=max(10, 2 * top), **index_options).graph
    by_id = Window.partitionBy("rep").orderBy("vec_id")
    few = members.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= top + 1).select("rep", F.col("vec_id").alias("other"))
    own = few.select("rep", "other", F.lit(1.0).alias("sim"))
    near = graph.where(F.round("sim", 9) >= least).select(F.col("a").alias("for"), F.col("b").alias("rep"), "sim").join(few, "rep").select(F.col("for").alias("rep"), "other", "sim")
    best = Window.partitionBy("rep").orderBy(F.desc("s"), "other")
    listed = own.unionByName(near).withColumn("s", F.round("sim", 9)).withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1)
    lists = listed.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x["other"]).alias("others"))
    out = members.join(lists, "rep").select("vec_id", F.explode(F.slice(F.filter("others", lambda o: o != F.col("vec_id")), 1, top)).alias("other"))
    return out.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()


def search(index: Index, queries: DataFrame, top: int = 5, beam: int = 16, entries: int = 4, max_steps: int = 64) -> DataFrame:
    """Greedy graph search: queries(query_id, v) -> (query_id, vec_id, sim), the ``top`` best found.

    A query starts at ``entries`` nodes of its leaf in every tree and goes on to the neighbours, either way, of the ``beam``
    best it has met until it has gone on from all of these; a node is compared with a query once. A query whose leaves
    were split or are empty starts at nodes spread over the graph.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("ij,ij->i", _arrow_to_unit(b.column(2)), _arrow_to_unit(b.column(3))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["query_id", "vec_id", "sim"])

    nodes, queries = index.nodes.select("vec_id", "v"), queries.select("query_id", "v").dropDuplicates(["query_id"])

    def compare(pairs: DataFrame) -> DataFrame:
        j = pairs.join(nodes, "vec_id").join(queries.withColumnRenamed("v", "q"), "query_id").select("query_id", "vec_id", "q", "v")
        return j.mapInArrow(score, "query_id bigint, vec_id bigint, sim double")

    spread = nodes.select("vec_id").orderBy(F.xxhash64("vec_id")).limit(entries * 4)
    if index.leaves is None:
        start = queries.select("query_id").join(spread)  # a graph of one node or none
    else:
        by_hash = Window.partitionBy("tree", "leaf").orderBy(F.xxhash64("vec_id"))
        doors = index.leaves.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= entries).drop("r")
        at = _place(queries.withColumnRenamed("query_id", "vec_id"), index.forest).select(F.col("vec_id").alias("query_id"), "tree", "leaf")
        start = cut(at.join(doors, ["tree", "leaf"]).select("query_id", "vec_id").distinct())
        lost = queries.select("query_id").join(start.select("query_id").distinct(), "query_id", "left_anti")
        start = start.unionByName(lost.join(F.broadcast(spread)))  # 16 rows
    seen = cut(compare(start))
    links = cut(index.graph.select("a", "b").unionByName(index.graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), "vec_id")
    gone_on = None
    for _ in range(max_steps):
        front = seen.withColumn("r", F.row_number().over(w)).where(F.col("r") <= beam).select("query_id", "vec_id")
        front = cut(front if gone_on is None else front.join(gone_on, ["query_id", "vec_id"], "left_anti"))
        if front.isEmpty():
            return seen.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")
        gone_on = front if gone_on is None else gone_on.unionByName(front)
        nxt = front.withColumnRenamed("vec_id", "a").join(links, "a").select("query_id", F.col("b").alias("vec_id")).distinct()
        seen = seen.unionByName(cut(compare(nxt.join(seen.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti"))))
    raise RuntimeError(f"the search did not end within {max_steps} steps")
