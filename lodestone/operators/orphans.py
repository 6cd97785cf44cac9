"""References to records that do not exist (foreign keys over time), direct and inherited.

A reference is alive if, of the target rows of its key that were created by then, the one that ends last has not ended
yet. So aliveness is a running maximum over time, which is taken in two steps: per key and day by partial aggregation (one row
a day, however hot the key), and inside the day of the reference. Rows are shuffled once, by key and day, so a
key that holds a third of all rows lies in as many tasks as it has days; spans are never gathered.

What dangles itself orphans the record that holds it, and with it the references to that record, to a fixpoint
(:func:`orphan_cascade`, :func:`orphan_levels`).

Defined results
---------------
* null keys (and, after trimming, null only) are no references and give no row;
* an empty string is a key like any other;
* rows repeated with the same id give one row;
* an empty target table makes every reference ``missing``; empty references give no rows;
* target spans that end before they begin, or without a creation time, never live;
* extra columns of the inputs are ignored: only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: White space that is removed around a reference before it is compared (Unicode white space).
_EDGE_SPACE = r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$"
SYMBOL_BY_NAME = "sym:?::"


def clean_reference(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_SPACE, "")


def clean_edge_id(c: Column) -> Column:
    return F.translate(clean_reference(c), "\\", "/")


def find_orphans(references: DataFrame, targets: DataFrame) -> DataFrame:
    """references(src_table, row_id, key, seen_at) x targets(key, created_at, removed_at) -> orphans with a reason.

    reason is ``missing`` (no target row at all), ``late`` (some target is created after the reference)
    or ``deleted``. Other columns of either side are left out.
    """
    never = F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))
    far = F.to_timestamp_ntz(F.lit("9999-12-31 00:00:00"))
    r = references.select("src_table", "row_id", "key", "seen_at").where("key is not null").withColumn("t", F.col("seen_at").cast("timestamp_ntz"))
    r = r.withColumn("d", F.to_date(F.coalesce("t", never)))
    x = targets.select("key", F.col("created_at").cast("timestamp_ntz").alias("t"), F.col("removed_at").cast("timestamp_ntz").alias("e")).where("key is not null")
    x = x.select("key", "t", F.coalesce("e", far).alias("e"), F.to_date(F.coalesce("t", never)).alias("d"))
    ends = F.when(F.col("t").isNotNull() & (F.col("e") > F.col("t")), F.col("e")).alias("e")
    # per key and day: the latest end among the rows created before that day, and the last creation of the key
    days = x.select("key", "d", "t", ends, F.lit(1).alias("k")).unionByName(r.select("key", "d", F.lit(None).cast("timestamp_ntz").alias("t"), F.lit(None).cast("timestamp_ntz").alias("e"), F.lit(0).alias("k")))
    days = days.groupBy("key", "d").agg(F.max("e").alias("e"), F.max("t").alias("t"), F.max("k").alias("k"), F.min("k").alias("used"))
    w = Window.partitionBy("key")
    before = F.max("e").over(w.orderBy("d").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("key", "d", before.alias("before"), F.max("t").over(w).alias("last"), F.max("k").over(w).alias("known"), "used").where("used = 0").drop("used")
    # inside the day: target rows come before references of the same time
    rows = r.select("key", "d", "t", F.lit(1).alias("side"), "src_table", "row_id", "seen_at", F.lit(None).cast("timestamp_ntz").alias("e")).unionByName(
        x.where("t is not null").select("key", "d", "t", F.lit(0).alias("side"), F.lit(None).cast("string").alias("src_table"), F.lit(None).cast(dict(r.dtypes)["row_id"]).alias("row_id"), F.lit(None).cast(dict(r.dtypes)["seen_at"]).alias("seen_at"), ends)
    )
    today = F.max("e").over(Window.partitionBy("key", "d").orderBy("t", "side").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    j = rows.withColumn("today", today).where("side = 1").join(days, ["key", "d"])
    alive = F.coalesce(F.greatest("today", "before") > F.col("t"), F.lit(False))
    reason = F.when(F.col("known") == 0, "missing").when(F.coalesce(F.col("last") > F.col("t"), F.lit(False)), "late").otherwise("deleted")
    return j.where(~alive).select("src_table", "row_id", "key", "seen_at", reason.alias("reason"))


def edge_references(edges: DataFrame) -> DataFrame:
    return edges.select(F.lit("edges").alias("src_table"), F.col("edge_id").alias("row_id"), clean_edge_id(F.col("dst_id")).alias("key"), "seen_at")


def node_targets(nodes: DataFrame) -> DataFrame:
    """The node of an id, and under ``sym:?::<name>`` every Symbol node of that name."""
    own = nodes.select(F.col("id").alias("key"), "created_at", "removed_at")
    named = nodes.where("kind = 'Symbol' and name is not null").select(F.concat(F.lit(SYMBOL_BY_NAME), "name").alias("key"), "created_at", "removed_at")
    return own.where(~F.col("key").startswith(SYMBOL_BY_NAME)).unionByName(named)


def ref_references(refs: DataFrame) -> DataFrame:
    return refs.select(F.lit("refs").alias("src_table"), F.col("ref_id").alias("row_id"), clean_reference(F.col("symbol")).alias("key"), "seen_at")


def import_references(imports: DataFrame) -> DataFrame:
    return imports.select(F.lit("imports").alias("src_table"), F.col("import_id").alias("row_id"), clean_reference(F.col("target")).alias("key"), "seen_at")


def all_orphans(edges: DataFrame, refs: DataFrame, imports: DataFrame, nodes: DataFrame, definitions: DataFrame) -> DataFrame:
    """src_table, row_id, key, seen_at, reason of the three reference tables."""
    modules = nodes.where(F.col("id").startswith("module:")).select(F.expr("substring(id, 8)").alias("key"), "created_at", "removed_at")
    symbols = definitions.select(F.col("symbol").alias("key"), "created_at", "removed_at")
    e = find_orphans(edge_references(edges), node_targets(nodes))
    r = find_orphans(ref_references(refs), symbols)
    i = find_orphans(import_references(imports), modules)
    cols = ["src_table", "row_id", "key", "seen_at", "reason"]
    # repeated rows have the same reason: it is enough to drop them among the orphans
    return e.select(cols).unionByName(r.select(cols)).unionByName(i.select(cols)).dropDuplicates(["src_table", "row_id"])


def record_links(edges: DataFrame, refs: DataFrame, imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """src_table, row_id, seen_at, owner, record: which record holds a reference and which one it leads to.

    An edge belongs to its source, references and imports to the node of their file. A reference by name (refs, and edges to
    ``sym:?::``) leads to a record only where exactly one Symbol node has the name.
    """
    one = nodes.where("kind = 'Symbol' and name is not null").groupBy("name").agg(F.min("id").alias("full_id"), F.max("id").alias("_hi")).where("full_id = _hi")
    one = one.select(F.concat(F.lit(SYMBOL_BY_NAME), "name").alias("record"), "full_id")
    e = edges.select(F.lit("edges").alias("src_table"), F.col("edge_id").alias("row_id"), "seen_at", clean_edge_id(F.col("src_id")).alias("owner"), clean_edge_id(F.col("dst_id")).alias("record"))
    r = refs.select(F.lit("refs").alias("src_table"), F.col("ref_id").alias("row_id"), "seen_at", F.concat(F.lit("file:"), "file").alias("owner"), F.concat(F.lit(SYMBOL_BY_NAME), clean_reference(F.col("symbol"))).alias("record"))
    i = imports.select(F.lit("imports").alias("src_table"), F.col("import_id").alias("row_id"), "seen_at", F.concat(F.lit("file:"), "file").alias("owner"), F.concat(F.lit("module:"), clean_reference(F.col("target"))).alias("record"))
    # one pass drops repeated rows; names that one node bears are joined on (one row per name, so a hot name is split)
    every = e.unionByName(r).unionByName(i).dropDuplicates(["src_table", "row_id"])
    return every.join(one, "record", "left").select("src_table", "row_id", "seen_at", "owner", F.coalesce("full_id", "record").alias("record"))


def orphan_levels(links: DataFrame, orphans: DataFrame) -> DataFrame:
    """links of :func:`record_links` and the orphans among them -> src_table, row_id, seen_at, reason, level.

    level 0 is a direct orphan, with its reason; a reference to a record that is orphaned at level n is ``inherited``
    at level n + 1, though its record is there.
    """
    links, orphans = cut(links), cut(orphans.select("src_table", "row_id", "seen_at", "reason"))
    direct = links.join(orphans.select("src_table", "row_id"), ["src_table", "row_id"], "left_semi").select(F.col("owner").alias("id"))
    known = orphan_cascade(links.select(F.col("owner").alias("child"), F.col("record").alias("parent")), direct)
    rest = links.join(orphans.select("src_table", "row_id"), ["src_table", "row_id"], "left_anti")
    inherited = rest.join(known.withColumnRenamed("id", "record"), "record").select("src_table", "row_id", "seen_at", F.lit("inherited").alias("reason"), (F.col("level") + 1).alias("level"))
    return orphans.withColumn("level", F.lit(0)).unionByName(inherited)


def orphan_report(levels: DataFrame) -> DataFrame:
    """Orphans per table, month of the reference and reason; ``direct`` tells those that dangle themselves from inherited ones."""
    return levels.groupBy("src_table", F.date_format("seen_at", "yyyy-MM").alias("month"), "reason", (F.col("level") == 0).alias("direct")).agg(F.count("*").alias("orphans"))


def orphan_cascade(links: DataFrame, orphan_ids: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Fixpoint: what refers to an orphaned record is indirectly orphaned itself.

    ``links(child, parent)``: child refers to parent; ``orphan_ids(id)``: records whose own reference
    dangles (level 0). Each round is one semi-join of the frontier with the links and one anti-join with
    what is known; the frontier is cut with a checkpoint. Returns id, level (0 = direct). Cycles end,
    because a known id never enters the frontier again.
    """
    links = cut(links.select("child", "parent").where("child is not null and parent is not null").distinct())
    known = cut(orphan_ids.select("id").where("id is not null").distinct().withColumn("level", F.lit(0)))
    frontier = known
    for level in range(1, max_rounds + 1):
        nxt = links.join(frontier.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id")).distinct()
        frontier = cut(nxt.join(known.select("id"), "id", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)  # both are cut already
    raise RuntimeError(f"the cascade did not end within {max_rounds} rounds")
