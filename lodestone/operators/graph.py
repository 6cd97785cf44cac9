"""Property graph: lookups, resolution of names, neighbours and multi-hop walks as joins of frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: the last created wins."""
    return nodes.groupBy("id").agg(F.max_by(F.struct("kind", "name", "file", "line", "repo", "created_at"), F.struct("created_at", "line", "file")).alias("n")).select("id", "n.*")


def delete_file(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the files and every edge that touches them go."""
    gone = nodes.join(files.select("file").distinct(), "file", "left_semi").select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
    return nodes.join(files.select("file").distinct(), "file", "left_anti"), kept


def resolve_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges into ``sym:?::name`` lead to every Symbol node of the name; those without one stay unresolved (null)."""
    s = nodes.where("kind = 'Symbol'").select("name", F.col("id").alias("resolved_id")).distinct()
    e = edges.where(F.col("dst_id").startswith("sym:?::")).withColumn("name", F.expr("substring(dst_id, 8)"))
    return e.join(s, "name", "left")


def multi_hop(edges: DataFrame, seeds: DataFrame, hops: int, kinds: list[str] | None = None) -> DataFrame:
    """seeds(seed, id) -> seed, id, hop, weight: nodes reached along outgoing edges, each at its fewest hops with the best sum of weights there."""
    e = edges.where("src_id is not null and dst_id is not null")
    e = e.where(F.col("kind").isin(*kinds)) if kinds else e
    e = cut(e.groupBy(F.col("src_id").alias("id"), F.col("dst_id").alias("to")).agg(F.max("weight").alias("w")))
    front = cut(seeds.select("seed", "id").distinct().withColumn("weight", F.lit(0.0)))
    seen, out = front.select("seed", "id"), None
    for hop in range(1, hops + 1):
        nxt = front.join(e, "id").select("seed", F.col("to").alias("id"), (F.col("weight") + F.col("w")).alias("weight")).groupBy("seed", "id").agg(F.max("weight").alias("weight"))
        front = nxt.join(seen, ["seed", "id"], "left_anti")
        front = cut(front) if hop < hops else front  # what the last hop reaches is read once only
        part = front.withColumn("hop", F.lit(hop))
        out = part if out is None else out.unionByName(part)
        seen = seen.unionByName(front.select("seed", "id"))
    return out.select("seed", "id", "hop", "weight")


def callers(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """References of a symbol outside the files that define it."""
    return refs.join(definitions.select("symbol", "file").distinct(), ["symbol", "file"], "left_anti")


def callee_links(refs: DataFrame, definitions: DataFrame, chunks: DataFrame) -> DataFrame:
    """symbol, kind, links: pairs of a chunk (chunk_id, file, start_line, end_line) and a definition, in another file, of what it refers to.

    The pairs of a symbol are a product, so they are counted without being listed: every chunk by every definition, less the
    chunks that refer to it in the definition's own file only. Rows of ``whole`` hold the first count, the others the second.
    """

    def both(file):
        return F.inline(F.array(F.struct(F.lit(True).alias("whole"), F.lit("").alias("file")), F.struct(F.lit(False).alias("whole"), file.alias("file"))))

    r = refs.where("symbol is not null").select("symbol", "file", "line").distinct()
    c = chunks.select("chunk_id", "file", "start_line", "end_line").distinct()
    inside = r.join(c, "file").where("line between start_line and end_line").groupBy("symbol", "chunk_id").agg(F.min("file").alias("first"), F.max("file").alias("last"))
    n = inside.select("symbol", both(F.when(F.col("first") == F.col("last"), F.col("first")))).where("file is not null").groupBy("symbol", "whole", "file").agg(F.count("*").alias("n"))
    d = definitions.where("symbol is not null and file is not null").select("symbol", "kind", F.col("file").alias("def_file"), "start_line").distinct()
    m = d.select("symbol", "kind", both(F.col("def_file"))).groupBy("symbol", "kind", "whole", "file").agg(F.count("*").alias("m"))
    links = F.sum(F.when(F.col("whole"), F.col("n") * F.col("m")).otherwise(-F.col("n") * F.col("m")))
    return m.join(n, ["symbol", "whole", "file"]).groupBy("symbol", "kind").agg(links.alias("links")).where("links > 0")


def importers(imports: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(part): import rows whose target holds the part.

    A text that holds the part holds all its three-letter pieces, so both sides meet on the part's rarest-looking piece
    instead of on every pair; parts under three letters are compared with distinct targets only.
    """
    imports = imports.select("file", "target", "line", "repo")
    w = wanted.where("part is not null").select("part").distinct()
    t = imports.select("target").where("target is not null").distinct()
    pieces = F.transform(F.sequence(F.lit(1), F.length("target") - 2), lambda i: F.col("target").substr(i, F.lit(3)))
    grams = t.where(F.length("target") >= 3).select("target", F.explode(F.array_distinct(pieces)).alias("g"))
    long = grams.join(w.where(F.length("part") >= 3).withColumn("g", F.substring("part", -3, 3)), "g").where(F.col("target").contains(F.col("part")))
    pairs = F.array_distinct(F.flatten(F.array(F.transform(F.sequence(F.lit(1), F.length("target")), lambda i: F.col("target").substr(i, F.lit(1))), F.when(F.length("target") >= 2, F.transform(F.sequence(F.lit(1), F.length("target") - 1), lambda i: F.col("target").substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>")))))
    short = t.where(F.length("target") >= 1).select("target", F.explode(pairs).alias("part")).join(w.where(F.length("part").between(1, 2)), "part")
    both = long.select("part", "target").unionByName(short.select("part", "target")).distinct()
    return imports.join(both, "target").select("part", "file", "target", "line", "repo")


def neighbours(calls: DataFrame, called: DataFrame, imported: DataFrame, most: int) -> DataFrame:
    """Three relations (key, file, line, symbol) in the order callers, callees, importers; the first ``most`` per key."""
    calls, called, imported = (x.select("key", "file", "line", "symbol") for x in (calls, called, imported))
    u = calls.withColumn("relation", F.lit("caller")).withColumn("_p", F.lit(0)).unionByName(called.withColumn("relation", F.lit("callee")).withColumn("_p", F.lit(1))).unionByName(imported.withColumn("relation", F.lit("importer")).withColumn("_p", F.lit(2)))
    u = u.select("key", "relation", "_p", "file", "line", "symbol").distinct()
    w = Window.partitionBy("key").orderBy("_p", "file", "line", "symbol")
    return u.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).drop("_p")
