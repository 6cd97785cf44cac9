"""The whole retrieval of a batch of queries as one lazily composed plan, and neighbours from the call graph.

Analysis -> variants -> lexical and (where vectors are given) vector lists -> fusion -> boosts -> floor -> call-graph
neighbours -> token budget. Every stage is keyed by query_id; texts are joined back at the end only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..session import cut
from . import graph, rules, search


def expand_with_graph(ranked: DataFrame, chunks: DataFrame, refs: DataFrame, definitions: DataFrame, most: int = 6, budget: int = 8000) -> DataFrame:
    """ranked(query_id, id, rank0, score) x chunks(id, file, symbol, start_line, end_line, tokens) -> added chunks.

    In the order of the ranks, the chunks that call a hit's symbol come in with a decayed score, each once, until there are
    ``most`` or the next would break the budget.
    """
    ranked = cut(ranked)
    hit = ranked.join(chunks.select("id", "file", "symbol"), "id").where("symbol is not null and symbol <> ''").select("query_id", "rank0", "score", "file", "symbol")
    wanted = hit.select("symbol").distinct()
    calls = graph.callers(refs.join(wanted, "symbol", "left_semi").where("file is not null and line is not null"), definitions).select("symbol", "file", "line").distinct()
    w = Window.partitionBy("symbol").orderBy("file", "line")
    calls = calls.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= max(2 * most, 8)).withColumn("point_id", F.xxhash64("symbol", "file", "line"))
    where = search.covering_chunk(calls.select("point_id", "file", "line"), chunks.select(F.col("id").alias("chunk_id"), "file", "start_line", "end_line")).select("point_id", F.col("chunk_id").alias("id"))
    at = calls.join(where, "point_id").select("symbol", "pos", F.col("file").alias("call_file"), "id")
    found = hit.join(at, "symbol").where("call_file <> file").join(ranked.select("query_id", "id"), ["query_id", "id"], "left_anti")
    first = found.groupBy("query_id", "id").agg(F.min(F.struct("rank0", "pos", "symbol", "score")).alias("f"))
    first = first.join(chunks.select("id", "tokens"), "id")
    order = Window.partitionBy("query_id").orderBy("f.rank0", "f.pos", "id")
    run = first.withColumn("n", F.row_number().over(order)).withColumn("used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where((F.col("n") <= most) & (F.col("used") <= budget)).select("query_id", "id", F.greatest(F.col("f.score") * fixed.NEIGHBOUR_DECAY, F.lit(fixed.MIN_RELEVANCE)).alias("score"), F.col("f.symbol").alias("via"), "tokens")


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, top: int = 30, budget: int = 100_000, most_variants: int = 3, index: search.LexicalIndex | None = None) -> DataFrame:
    """queries(query_id, query) x chunks(id, file, symbol, text) -> query_id, pos, id, file, score, tokens, used.

    ``vectors(id, embedding)`` and ``query_vectors(query_id, embedding)`` add the vector side; a caller with its own
    hypothetical answers gives their vectors here. ``index`` is an index of the chunks that was opened before; without one it
    is made for this call.
    """
    a = cut(rules.analyse(queries))  # both are used by several stages
    v = rules.variants(a, most_variants).select((F.col("query_id") * 16 + F.col("variant")).alias("query_id"), "text")
    index = index or search.LexicalIndex.of(chunks.select("id", "text"))
    lexical = index.search(v, fixed.CANDIDATE_POOL).withColumn("query_id", F.floor(F.col("query_id") / 16).cast("bigint"))
    lexical = search.ranked(search.fuse([(lexical, 1.0)]), "query_id", "fused", "id", fixed.CANDIDATE_POOL)
    alpha = a.select("query_id", "alpha", "symbols", "paths")
    parts = lexical.join(alpha, "query_id").select("query_id", "id", ((1 - F.col("alpha")) / (fixed.RRF_K + F.col("rank0"))).alias("part"))
    if vectors is not None and query_vectors is not None:
        near = search.nearest(vectors, query_vectors, fixed.CANDIDATE_POOL).join(alpha, "query_id")
        parts = parts.unionByName(near.select("query_id", "id", (F.col("alpha") / (fixed.RRF_K + F.col("rank0"))).alias("part")))
    fused = parts.groupBy("query_id", "id").agg(F.sum("part").alias("fused"))
    meta = chunks.select("id", "file", "symbol", T.estimated_tokens(F.col("text")).alias("tokens"))
    j = fused.join(meta, "id").join(alpha, "query_id")
    names = F.transform("symbols", lambda s: F.lower(s))
    own = F.array(F.lower(F.coalesce("symbol", F.lit(""))), F.lower(F.regexp_extract(F.coalesce("symbol", F.lit("")), r"([^.\s]*)$", 1)))
    on_path = F.exists("paths", lambda x: F.lower(F.translate("file", "\\", "/")).contains(F.lower(x)))
    b = j.withColumn("score", search.boost(F.col("fused"), F.arrays_overlap(names, own), on_path))
    best = search.ranked(b.select("query_id", "id", "file", "tokens", "score"), "query_id", "score", "id", top)
    return search.budget_prefix(best, "query_id", ["rank0"], "tokens", budget).select("query_id", F.col("rank0").alias("pos"), "id", "file", "score", "tokens", "used")
