"""The public query API: named tools with parameters over the tables of a data directory; each gives a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, ingest, search
from .operators.retrieve import retrieve
from .plans import graphs as G
from .plans import ingest as I
from .sources.tables import table

MOST_CHARS = 24_000


def _retrieve(spark, d, query: str, top_k: int = 12) -> DataFrame:
    c = I.meta(spark, d, "file", "symbol", "doc").select(F.xxhash64("chunk_id").alias("id"), "file", "symbol", F.col("doc").alias("text"))
    return retrieve(spark.createDataFrame([(1, query)], "query_id bigint, query string"), c, top=top_k, budget=20_000)


def _read_file(spark, d, path: str, start_line: int = 1, end_line: int = 0) -> DataFrame:
    return _read_files(spark, d, [{"path": path, "start_line": start_line, "end_line": end_line}])


def _read_files(spark, d, items: list) -> DataFrame:
    want = spark.createDataFrame([(x["path"], int(x.get("start_line") or 1), int(x.get("end_line") or 0)) for x in items], "file string, first int, last int")
    lines = I.numbered(spark, d).join(want, "file").where((F.col("line") >= F.col("first")) & ((F.col("last") <= 0) | (F.col("line") <= F.col("last"))) & (F.col("line") < F.col("first") + 400))
    return lines.select("file", "line", "line_text").orderBy("file", "line")


def _grep(spark, d, pattern: str, path_glob: str = "") -> DataFrame:
    return ingest.grep(I.numbered(spark, d), pattern, path_glob).orderBy("file", "line").limit(30)


def _find_symbol(spark, d, symbol: str) -> DataFrame:
    return table(spark, d, "definitions", ["symbol", "file", "kind", "start_line", "end_line", "repo"]).distinct().where(F.col("symbol") == symbol).orderBy("file", "start_line").limit(50)


def _find_callers(spark, d, symbol: str) -> DataFrame:
    return graph.callers(G.refs(spark, d).where(F.col("symbol") == symbol), G.defs(spark, d)).select("symbol", "file", "line", "repo").distinct().orderBy("file", "line").limit(50)


def _find_importers(spark, d, target: str) -> DataFrame:
    return graph.importers(G.imports(spark, d), spark.createDataFrame([(target,)], "part string")).drop("part").orderBy("file", "line").limit(50)


def _repo_map(spark, d, query: str = "", top_files: int = 30) -> DataFrame:
    from .functions import text as T

    m = search.repo_map(I.meta(spark, d, "file", "repo", "symbol", "start_line", "end_line"))
    if query:
        words = F.array_distinct(T.search_tokens(F.lit(query)))
        m = m.withColumn("score", F.size(F.array_intersect(T.search_tokens(F.concat_ws(" ", "file", F.array_join("symbols", " "))), words))).where("score > 0")
        return m.orderBy(F.desc("score"), "file").limit(top_files)
    return m.orderBy("file").limit(top_files)


def _find_implementations(spark, d, base: str) -> DataFrame:
    return G.edges(spark, d).where(F.col("kind") == "INHERITS").where((F.col("dst_id") == f"sym:?::{base}") | F.col("dst_id").endswith(f"::{base}")).select("src_id", "dst_id", "line").distinct().orderBy("src_id").limit(50)


def _graph_neighbors(spark, d, file: str, symbol: str = "", kinds: list | None = None, max_hops: int = 2, max_results: int = 25) -> DataFrame:
    seed = f"sym:{file}::{symbol}" if symbol else f"file:{file}"
    hops = graph.multi_hop(G.edges(spark, d), spark.createDataFrame([("s", seed)], "seed string, id string"), max_hops, kinds)
    return hops.orderBy("hop", F.desc("weight"), "id").limit(max_results)


def _recent_changes(spark, d, lookback: int = 20) -> DataFrame:
    m = table(spark, d, "store_meta", ["file", "indexed_at"]).groupBy("file").agg(F.max("indexed_at").alias("changed_at"))
    return m.orderBy(F.desc("changed_at"), "file").limit(min(lookback, 80)).select("file")


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "retrieve": _retrieve, "read_file": _read_file, "read_files": _read_files, "grep": _grep, "find_symbol": _find_symbol, "find_callers": _find_callers, "find_importers": _find_importers,
    "repo_map": _repo_map, "find_implementations": _find_implementations, "graph_neighbors": _graph_neighbors, "recent_changes": _recent_changes,
}


def memo_key(name: str, arguments: str) -> str:
    """A call's name with its arguments written with sorted keys."""
    try:
        return f"{name}:{json.dumps(json.loads(arguments or '{}'), sort_keys=True)}"
    except ValueError:
        return f"{name}:{arguments}"


def dispatch(spark: SparkSession, root: str, name: str, arguments: str = "{}", memo: dict[str, str] | None = None) -> str:
    """Runs a tool on JSON arguments and renders its rows as text; errors come as text too."""
    key = memo_key(name, arguments)
    if memo is not None and key in memo:
        return memo[key]
    try:
        if name not in TOOLS:
            raise KeyError(f"unknown tool {name}")
        rows = TOOLS[name](spark, root, **json.loads(arguments or "{}")).limit(1000).collect()
        out = "\n".join("\t".join("" if x is None else str(x) for x in r) for r in rows) or "(no results)"
    except Exception as e:  # noqa: BLE001 - a tool call must always answer
        out = f"error: {type(e).__name__}: {str(e).splitlines()[0][:300] if str(e) else ''}"
    out = out if len(out) <= MOST_CHARS else out[:MOST_CHARS] + "\n... (cut)"
    if memo is not None:
        memo[key] = out
    return out
