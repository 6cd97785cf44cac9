"""Parent-child links to full hierarchies: path, depth, root, descendants and cycles.

Every id has one parent, so a connected component is a tree below its root, or a cycle with the trees that hang on it.
Components are found by pointer doubling (:func:`climb`): every round an id that has not reached a top jumps to where its
current ancestor points; what has arrived is written once and not touched again, and the rounds end when nothing arrives
any more, since then only cycles and what hangs on them are left. A component of at most ``co_locate`` ids is brought into one
task and walked depth first with node colouring, which gives roots, depths, lines of ancestors and back edges. A larger one (a hot
tree may hold a third of all rows) is never brought into one task: there the same columns come from doubling alone.

Defined results
---------------
* links with a null end are dropped; an id that links to itself is a cycle of length one;
* repeated links count once; if an id has several parents, the smallest parent id is its parent, and the others are
  ids of their own (roots, unless they have parents);
* an id on a cycle, or whose line of parents runs into one, has root ``CYCLE`` and depth -1;
* the back edge of a cycle is the link into its smallest id; every cycle has one;
* the line of an id holds its ancestors, the nearest first; on a cycle, the other ids of the cycle, each once;
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .orphans import SYMBOL_BY_NAME, clean_edge_id

CYCLE = "CYCLE"


def parent_links(links: DataFrame) -> DataFrame:
    """child -> one parent, plus a row with parent null for ids that only occur as parents."""
    pairs = links.select("child", "parent").where("child is not null and parent is not null")
    # one pass: a link shows its child with the parent, and its parent without one
    both = pairs.select(F.explode(F.array(F.struct(F.col("child"), F.col("parent")), F.struct(F.col("parent").alias("child"), F.lit(None).cast("string").alias("parent")))).alias("x"))
    return both.groupBy(F.col("x.child").alias("child")).agg(F.min("x.parent").alias("parent"))


#: How a column of an id and the same column of the id its pointer leads to are put together.
_TOGETHER = {"steps": lambda a, b: F.col(a) + F.col(b), "line": lambda a, b: F.concat(a, b), "low": lambda a, b: F.least(a, b)}


def _jump(active: DataFrame, every: DataFrame, fold: list[str], take: list[str] = []) -> DataFrame:
    """Follows the pointers of ``every`` three times: a pointer over n steps becomes one over 4n."""
    for _ in range(3):
        hop = every.select(F.col("id").alias("up"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in [*fold, *take]])
        active = active.join(hop, "up").select("id", F.col("_up").alias("up"), *[_TOGETHER[c](c, f"_{c}").alias(c) for c in fold], *[F.col(f"_{c}").alias(c) for c in take])
    return active


def climb(parents: DataFrame, lines: bool = False, max_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(child, parent) -> what reaches a top: (id, root, depth[, line]); and the links of what never does: (child, parent).

    After k rounds every id with a depth of at most 4^k has arrived. A round in which none arrives has therefore met
    no id with a depth between 4^k and 4^(k+1), and there can be no deeper one.
    """
    own = [F.array("parent").alias("line")] if lines else []
    none = [F.array().cast("array<string>").alias("line")] if lines else []
    tops = parents.where("parent is null").select(F.col("child").alias("id"), F.col("child").alias("up"), F.lit(0).cast("bigint").alias("steps"), *none, F.lit(True).alias("done"))
    active = parents.where("parent is not null").select(F.col("child").alias("id"), F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("steps"), *own, F.lit(False).alias("done"))
    arrived, left = tops, None
    for _ in range(max_rounds):
        every = arrived.unionByName(active)
        state = cut(_jump(active.select("id", "up", "steps", *(["line"] if lines else [])), every, ["steps", *(["line"] if lines else [])], ["done"]))
        n = state.agg(F.count_if("done"), F.count_if(~F.col("done"))).first()
        arrived = arrived.unionByName(state.where("done"))
        active, left = state.where("not done"), n[1]
        if not n[0] or not left:
            break
    else:
        raise RuntimeError(f"lines of parents did not end within {max_rounds} rounds")
    found = arrived.select("id", F.col("up").alias("root"), F.col("steps").cast("int").alias("depth"), *(["line"] if lines else []))
    rest = parents.where("parent is not null").join(active.select(F.col("id").alias("child")), "child", "left_semi").select("child", "parent") if left else parents.limit(0).select("child", "parent")
    return found, rest


def rings(rest: DataFrame, lines: bool = False) -> DataFrame:
    """Links of which none leads to a top -> id, component (the smallest id of the cycle), on_ring[, line].

    Doubling over as many steps as there are ids: then every pointer is on a cycle, and the smallest id that an id of a
    cycle has passed is the smallest of the cycle.
    """
    rest = cut(rest)
    size = rest.count()
    own = [F.array("parent").alias("line")] if lines else []
    state = rest.select(F.col("child").alias("id"), F.col("parent").alias("up"), F.least("child", "parent").alias("low"), *own)
    steps = 1
    while steps < size:
        state = _jump(state, state, ["low", *(["line"] if lines else [])])
        state = cut(state.withColumn("line", F.array_distinct("line")) if lines else state)
        steps *= 4
    ends = state.groupBy("up").agg(F.lit(True).alias("on_ring")).withColumnRenamed("up", "id")
    lows = state.join(ends, "id").select(F.col("id").alias("up"), F.col("low").alias("component"))
    out = state.join(lows, "up").join(ends, "id", "left").select("id", "component", F.coalesce("on_ring", F.lit(False)).alias("on_ring"), *(["line"] if lines else []))
    return out.withColumn("line", F.filter("line", lambda x: x != F.col("id"))) if lines else out


def components(parents: DataFrame) -> DataFrame:
    """(child, parent) -> (id, component): the root of its tree, or the smallest id of the cycle it runs into."""
    found, rest = climb(parents)
    return found.select("id", F.col("root").alias("component")).unionByName(rings(rest).select("id", "component"))


def _walk(group: pd.DataFrame, lines: bool) -> pd.DataFrame:
    """Iterative depth-first walk of whole components: white = unseen, grey = on the current line, black = done."""
    up = dict(zip(group["child"], group["parent"]))
    root: dict[str, str] = {}
    depth: dict[str, int] = {}
    back: dict[str, str] = {}
    above: dict[str, list[str]] = {}
    for start in up:
        line, grey, at = [], set(), start
        while at is not None and at not in root and at not in grey:
            grey.add(at)
            line.append(at)
            at = up.get(at)
            at = None if pd.isna(at) else at
        if at is None:
            r, d = line[-1], -1
        elif at in grey:
            ring = line[line.index(at) :]
            low = ring.index(min(ring))
            back[ring[low - 1]] = ring[low]
            r, d = CYCLE, None
            if lines:
                for i, x in enumerate(ring):
                    above[x] = ring[i + 1 :] + ring[:i]
        else:
            r, d = root[at], depth[at]
            d = None if r == CYCLE else d
        for x in reversed(line):
            d = None if d is None else d + 1
            root[x], depth[x] = r, -1 if d is None else d
            if lines and x not in above:
                p = up[x]
                above[x] = [] if d == 0 else [p, *above[p]]
    ids = list(up)
    out = pd.DataFrame({"node_id": ids, "root_id": [root[i] for i in ids], "depth": [depth[i] for i in ids], "back_edge_to": [back.get(i) for i in ids]})
    if lines:
        out["line"] = [above[i] for i in ids]
    return out


def _walk_batches(lines: bool):
    """Partitions hold whole components, sorted: every component is cut out and walked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            last = b["component"].iloc[-1]
            if held and held[0]["component"].iloc[0] == last:
                held.append(b)
                continue
            full = pd.concat([*held, b[b["component"] != last]])
            held = [b[b["component"] == last]]
            if len(full):
                yield _walk(full, lines)
        if held:
            yield _walk(pd.concat(held), lines)

    return run


def build_hierarchy(links: DataFrame, co_locate: int = 100_000, lines: bool = False) -> DataFrame:
    """links(child, parent) -> node_id, root_id, depth, back_edge_to and, with ``lines``, line (the ancestors, the nearest first)."""
    parents = cut(parent_links(links))
    found, rest = climb(parents)
    ring = cut(rings(rest))
    label = found.select("id", F.col("root").alias("component"), "depth").unionByName(ring.select("id", "component", F.lit(-1).alias("depth")))
    big = cut(label.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > co_locate).select("component"))
    placed = parents.join(label.withColumnRenamed("id", "child"), "child")
    schema = "node_id string, root_id string, depth int, back_edge_to string" + (", line array<string>" if lines else "")
    none = big.isEmpty()
    small = placed if none else placed.join(big, "component", "left_anti")
    small = small.select("component", "child", "parent").repartition("component").sortWithinPartitions("component")
    out = small.mapInPandas(_walk_batches(lines), schema)
    if none:
        return out
    large = placed.join(big, "component", "left_semi")
    # the link of a cycle that leads into its smallest id
    closing = parents.join(ring.where("on_ring").select(F.col("id").alias("child"), F.col("component").alias("parent")), ["child", "parent"]).select(F.col("child").alias("node_id"), F.col("parent").alias("back_edge_to"))
    far = large.select(F.col("child").alias("node_id"), F.when(F.col("depth") < 0, CYCLE).otherwise(F.col("component")).alias("root_id"), "depth").join(closing, "node_id", "left")
    if lines:
        tree, cyclic = climb(cut(large.select("child", "parent")), lines=True)
        far = far.join(tree.select(F.col("id").alias("node_id"), "line").unionByName(rings(cyclic, lines=True).select(F.col("id").alias("node_id"), "line")), "node_id")
    return out.unionByName(far.select(out.columns))


def inherits_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """INHERITS edges as (child, parent) with cleaned ids and by-name ids resolved where one Symbol has the name."""
    e = edges.where("kind = 'INHERITS'").select(clean_edge_id(F.col("src_id")).alias("child"), clean_edge_id(F.col("dst_id")).alias("parent")).where("child is not null and parent is not null").distinct()
    names = e.select("child").union(e.select("parent")).where(F.col("child").startswith(SYMBOL_BY_NAME)).select(F.expr(f"substring(child, {len(SYMBOL_BY_NAME) + 1})").alias("name")).distinct()
    one = nodes.where("kind = 'Symbol'").join(names, "name", "left_semi").groupBy("name").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo = hi")
    one = one.select(F.concat(F.lit(SYMBOL_BY_NAME), "name").alias("alias_id"), F.col("lo").alias("full_id"))
    for side in ("child", "parent"):
        e = e.join(one.withColumnRenamed("alias_id", side), side, "left").withColumn(side, F.coalesce("full_id", side)).drop("full_id")
    return e.select("child", "parent").distinct()


def descendant_pairs(links: DataFrame, co_locate: int = 100_000) -> DataFrame:
    """ancestor, descendant, distance: every id with each id below it; on a cycle, with all others of the cycle.

    The pairs are the lines of ancestors taken apart, so they are written once and never joined with each other.
    """
    h = build_hierarchy(links, co_locate, lines=True)
    return h.select(F.col("node_id").alias("descendant"), F.posexplode("line").alias("_i", "ancestor")).select("ancestor", "descendant", (F.col("_i") + 1).cast("bigint").alias("distance"))


def node_paths(links: DataFrame, co_locate: int = 100_000) -> DataFrame:
    """node_id, root_id, depth, path (root first, joined by `` > ``; null without a root) and descendants.

    A row holds its own line only; descendants are counted from the lines by partial aggregation.
    """
    h = cut(build_hierarchy(links, co_locate, lines=True).select("node_id", "root_id", "depth", "line"))
    below = h.select(F.explode("line").alias("node_id")).groupBy("node_id").agg(F.count("*").alias("descendants"))
    path = F.concat_ws(" > ", F.reverse("line"), F.col("node_id"))
    return h.join(below, "node_id", "left").select("node_id", "root_id", "depth", F.when(F.col("depth") >= 0, path).alias("path"), F.coalesce("descendants", F.lit(0)).cast("bigint").alias("descendants"))
