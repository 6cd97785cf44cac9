"""Lexical and vector search, fusion, floors, context packing.

BM25 counts the terms of a text inside its row; only statistics per term are shuffled, after partial aggregation. A search
joins the few weighted terms of the queries to the texts' terms, sums up where the text lies and cuts every query's list before
lists are merged. :class:`LexicalIndex` can be written once and searched many times. Exact vector search multiplies
blocks of queries by blocks of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..session import cut


def term_counts(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> id, dl (tokens), terms (array of term, tf), counted inside the row; null and empty texts have none."""
    t = docs.select("id", F.coalesce(F.array_sort(T.search_tokens(F.col("text"))), F.array().cast("array<string>")).alias("_t"))
    # places where a run of equal tokens begins
    begins = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: F.coalesce(F.get("_t", i) != F.get("_t", i - 1), F.lit(True)))
    t = t.select("id", "_t", F.size("_t").cast("bigint").alias("dl"), F.when(F.size("_t") > 0, begins).otherwise(F.array().cast("array<int>")).alias("_s"))
    ends = F.transform("_s", lambda at, i: F.struct(F.get("_t", at).alias("term"), (F.coalesce(F.get("_s", i + 1), F.col("dl").cast("int")) - at).cast("bigint").alias("tf")))
    return t.select("id", "dl", ends.alias("terms"))


def term_stats(counted: DataFrame) -> DataFrame:
    """(id, dl, terms) -> term, df, total, live: one pass; the row of the empty term counts texts, tokens and texts that have tokens."""
    own = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["tf"].alias("n")))
    # the outer form: for the inner one a filter on the list's size is inferred, which would work the list out once more per term
    e = counted.select(F.explode_outer(F.concat(own, F.array(F.struct(F.lit("").alias("term"), F.col("dl").alias("n"))))).alias("t"))
    return e.groupBy(F.col("t.term").alias("term")).agg(F.count("*").alias("df"), F.sum("t.n").alias("total"), F.count_if(F.col("t.n") > 0).alias("live"))


class LexicalIndex:
    """BM25 over texts: ``postings`` (id, dl, term, tf) and, per term, ``weights`` (term, df, idf)."""

    #: Query terms up to this number are sent to all tasks (some 60 bytes each); beyond it the join is shuffled.
    MOST_SENT = 400_000
    #: Query terms up to this number are looked up in a written index by its sorted terms.
    MOST_LOOKED_UP = 2_000

    def __init__(self, postings: DataFrame, stats: DataFrame, written: bool = False) -> None:
        self.postings, self.stats, self.written = postings, stats, written
        row = stats.where("term = ''").first()
        self.n, self.mean = (row["df"], row["total"] / row["live"] if row["live"] else 1.0) if row else (0, 1.0)
        raw = F.ln(F.lit(self.n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
        terms = stats.where("term <> ''").select("term", "df", raw.alias("raw"))
        low = (terms.agg(F.avg("raw")).first()[0] or 0.0) * fixed.BM25_EPSILON
        self.weights = terms.select("term", "df", F.when(F.col("raw") < 0, F.lit(low)).otherwise(F.col("raw")).alias("idf"))

    @classmethod
    def of(cls, docs: DataFrame) -> LexicalIndex:
        """Of docs(id, text), one row per id. Texts that are partitioned by id aren't shuffled by a search."""
        c = term_counts(docs)
        return cls(c.select("id", "dl", F.explode_outer("terms").alias("t")).select("id", "dl", "t.term", "t.tf").where("term is not null"), cut(term_stats(c)))

    def write(self, folder: str) -> None:
        """Postings sorted by term, so that a search reads the row groups of its terms only."""
        self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
        self.stats.repartition(1).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/stats")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LexicalIndex:
        return cls(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/stats"), written=True)

    def search(self, queries: DataFrame, most: int, positive: bool = False) -> DataFrame:
        """queries(query_id, text) -> query_id, id, score, rank0: the ``most`` best; a repeated query token counts each time.

        ``positive`` leaves out scores of 0 and less before the lists are cut.
        """
        q = queries.select("query_id", F.explode(T.search_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
        w = cut(q.join(self.weights, "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("g")))
        p, n = self.postings, w.count()
        if self.written and n <= self.MOST_LOOKED_UP:
            p = p.where(F.col("term").isin([r[0] for r in w.select("term").distinct().collect()]))  # at most MOST_LOOKED_UP
        hit = p.join(F.broadcast(w) if n <= self.MOST_SENT else w, "term")
        k1, b = fixed.BM25_K1, fixed.BM25_B
        gain = F.col("g") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(self.mean)))
        scored = hit.groupBy("query_id", "id").agg(F.sum(gain).alias("score"))
        return ranked(scored.where("score > 0") if positive else scored, "query_id", "score", "id", most)


def ranked(df: DataFrame, by: str, score: str, tie: str, most: int | None = None) -> DataFrame:
    """Adds rank0, from 0; scores are rounded before they are compared, ties go to the smaller id.

    With ``most`` every partition cuts its lists to so many rows before they are shuffled.
    """
    w = Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), tie)
    out = df.withColumn("_r", F.row_number().over(w))
    out = out.where(F.col("_r") <= most) if most else out
    return out.withColumn("rank0", F.col("_r") - 1).drop("_r")


def fuse(lists: list[tuple[DataFrame, float]], k: int = fixed.RRF_K) -> DataFrame:
    """Ranked lists (query_id, id, rank0) with weights -> query_id, id, fused: the sum of w / (k + rank0)."""
    out = None
    for df, weight in lists:
        part = df.select("query_id", "id", (F.lit(float(weight)) / (F.lit(k) + F.col("rank0"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id", "id").agg(F.sum("part").alias("fused"))


def nearest(vectors: DataFrame, queries: DataFrame, most: int, query_block: int = 4096, row_block: int = 65536) -> DataFrame:
    """Exact inner-product search: vectors(id, embedding) x queries(query_id, embedding) -> query_id, id, sim.

    Both sides are cut into blocks; every pair of blocks is one matrix product that keeps the ``most`` best of each
    query, and the blocks' lists are merged by a ranked window. Rows are sent once per query block.
    """
    nq = max(1, -(-queries.count() // query_block))
    nv = max(1, -(-vectors.count() // row_block))
    q = queries.select("query_id", F.col("embedding").alias("qe"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("qb")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    v = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int").alias("vb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("qb", F.col("qb").cast("bigint"))

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "sim": []}).astype({"query_id": "int64", "id": "int64", "sim": "float64"})
        b = b.sort_values("id", kind="stable")
        x, y = np.stack(a["qe"]).astype(np.float64), np.stack(b["embedding"]).astype(np.float64)
        s = np.round(x @ y.T, 9)
        m = min(most, s.shape[1])
        top = np.argsort(-s, axis=1, kind="stable")[:, :m]
        rows = np.repeat(np.arange(len(a)), m)
        return pd.DataFrame({"query_id": a["query_id"].to_numpy()[rows], "id": b["id"].to_numpy()[top.ravel()], "sim": s[rows, top.ravel()]})

    lists = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(multiply, "query_id bigint, id bigint, sim double")
    return ranked(lists, "query_id", "sim", "id", most)


def boost(fused: Column, symbol_hit: Column, path_hit: Column) -> Column:
    """Multiplicative boosts."""
    return fused * F.when(symbol_hit, 1 + fixed.SYMBOL_BOOST).otherwise(1.0) * F.when(path_hit, 1 + fixed.PATH_BOOST).otherwise(1.0)


def adaptive_floor(scored: DataFrame, by: str, score: str, floor: float = 0.0, relative: float = fixed.RELATIVE_FLOOR, most: int = fixed.RERANK_TOP, tie: str = "id") -> DataFrame:
    """Keeps what reaches the larger of ``floor`` and ``relative`` times the best score, at most ``most``."""
    best = F.max(score).over(Window.partitionBy(by))
    return ranked(scored.where(F.col(score).isNotNull()).withColumn("_best", best).where(F.col(score) >= F.greatest(F.lit(floor), F.col("_best") * relative)).drop("_best"), by, score, tie, most)


def merge_ranges(ranges: DataFrame, pad: int = fixed.PAD_LINES) -> DataFrame:
    """ranges(file, start_line, end_line, last_line): padded, clamped, and merged where they touch."""
    p = ranges.select("file", F.greatest(F.lit(1), F.col("start_line") - pad).alias("s"), F.least("last_line", F.col("end_line") + pad).alias("e")).distinct()
    w = Window.partitionBy("file").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = p.withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach + 1), 1).otherwise(0)).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("file", "_i").agg(F.min("s").alias("start_line"), F.max("e").alias("end_line")).drop("_i")


def covering_chunk(points: DataFrame, chunks: DataFrame, bin_lines: int = 64) -> DataFrame:
    """points(point_id, file, line) x chunks(file, chunk_id, start_line, end_line): the chunk that covers the line, else the nearest.

    Covering is an equi-join on (file, bin of lines); only points that nothing covers look at their file's chunks.
    """
    points, chunks = points.select("point_id", "file", "line"), chunks.select("file", "chunk_id", "start_line", "end_line")
    c = chunks.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_line") / bin_lines), F.floor(F.col("end_line") / bin_lines))))
    p = points.withColumn("_b", F.floor(F.col("line") / bin_lines))
    inside = p.join(c, ["file", "_b"]).where("line between start_line and end_line").groupBy("point_id").agg(F.min_by("chunk_id", F.struct("start_line", "chunk_id")).alias("chunk_id")).withColumn("covers", F.lit(True))
    rest = points.join(inside.select("point_id"), "point_id", "left_anti").join(chunks, "file")
    far = F.least(F.abs(F.col("line") - F.col("start_line")), F.abs(F.col("line") - F.col("end_line")))
    near = rest.groupBy("point_id").agg(F.min_by("chunk_id", F.struct(far, F.col("start_line"), F.col("chunk_id"))).alias("chunk_id")).withColumn("covers", F.lit(False))
    return inside.unionByName(near)


def last_before(points: DataFrame, marks: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """As-of join: every point with the ``value`` of the last mark at or before it within ``by``; one union and one window."""
    a = points.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(dict(marks.dtypes)[value]))
    b = marks.select(*[F.col(c) if c in (by, at) else F.lit(None).cast(t).alias(c) for c, t in points.dtypes], F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(by).orderBy(at, "_side", F.asc_nulls_last("_v")).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def budget_prefix(rows: DataFrame, by: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    """Rows in order while their running sum of tokens stays within the budget."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def emit_blocks(hits: DataFrame, budget: int, most_blocks: int) -> DataFrame:
    """hits(query_id, rank0, file, file_chars, start_line, end_line, last_line, tokens, file_tokens) -> context blocks.

    Files come in the order of their first hit. Two hits in a file that isn't too long give the whole file, else its
    padded ranges. A whole file over the budget ends the list, a range over it ends its file.
    """
    schema = "query_id bigint, pos int, file string, mode string, start_line int, end_line int, tokens bigint, used bigint"

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        out, used = [], 0
        g = g.sort_values("rank0")
        for file, h in g.groupby("file", sort=False):
            one = h.iloc[0]
            if len(out) >= most_blocks:
                break
            if len(h) >= fixed.WHOLE_FILE_HITS and one["file_chars"] <= fixed.WHOLE_FILE_CHARS:
                t = int(one["file_tokens"])
                if used + t > budget:
                    break
                used += t
                out.append((int(one["query_id"]), len(out), file, "whole_file", 1, int(one["last_line"]), t, used))
                continue
            spans: list[list[int]] = []
            for s, e in sorted({(max(1, s - fixed.PAD_LINES), min(m, e + fixed.PAD_LINES)) for s, e, m in zip(h["start_line"], h["end_line"], h["last_line"])}):
                if spans and s <= spans[-1][1] + 1:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            for s, e in spans:
                t = -(-int(one["file_tokens"]) * (e - s + 1) // max(1, int(one["last_line"])))
                if used + t > budget or len(out) >= most_blocks:
                    break
                used += t
                out.append((int(one["query_id"]), len(out), file, "range", s, e, t, used))
        return pd.DataFrame(out, columns=["query_id", "pos", "file", "mode", "start_line", "end_line", "tokens", "used"])

    return hits.groupBy("query_id").applyInPandas(fold, schema)  # at most a candidate pool of rows a query


def max_sim(doc_tokens: DataFrame, query_tokens: DataFrame, query_block: int = 4096, row_block: int = 65536) -> DataFrame:
    """Late interaction: doc_tokens(doc, id, embedding), query_tokens(query_id, pos, embedding) -> query_id, doc, score.

    The score is the sum over the query's tokens of each one's best match in the document. Blocks of query tokens meet
    blocks of document tokens; a block pair gives one row per query token and document.
    """
    nq = max(1, -(-query_tokens.count() // query_block))
    nv = max(1, -(-doc_tokens.count() // row_block))
    q = query_tokens.select("query_id", "pos", F.col("embedding").alias("qe"), F.pmod(F.xxhash64("query_id", "pos"), F.lit(nq)).cast("int").alias("qb")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    v = doc_tokens.select("doc", "embedding", F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int").alias("vb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "pos": [], "doc": [], "m": []}).astype({"query_id": "int64", "pos": "int64", "doc": "int64", "m": "float64"})
        b = b.sort_values("doc", kind="stable")
        doc = b["doc"].to_numpy()
        first = np.concatenate([[0], np.nonzero(doc[1:] != doc[:-1])[0] + 1])
        s = np.maximum.reduceat(np.round(np.stack(a["qe"]).astype(np.float64) @ np.stack(b["embedding"]).astype(np.float64).T, 9), first, axis=1)
        n = len(first)
        return pd.DataFrame({"query_id": np.repeat(a["query_id"].to_numpy(), n), "pos": np.repeat(a["pos"].to_numpy(), n), "doc": np.tile(doc[first], len(a)), "m": s.ravel()})

    m = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(best, "query_id bigint, pos bigint, doc bigint, m double")
    return m.groupBy("query_id", "pos", "doc").agg(F.max("m").alias("m")).groupBy("query_id", "doc").agg(F.sum("m").alias("score"))


def repo_map(chunks: DataFrame, most: int = fixed.REPO_MAP_SYMBOLS) -> DataFrame:
    """chunks(file, repo, symbol, start_line, end_line) -> per file its first ``most`` symbols in order and its lines.

    Symbols are made distinct and ranked before they are listed, so a list never grows over ``most``.
    """
    per_file = chunks.groupBy("file").agg(F.min("repo").alias("repo"), F.max("end_line").alias("lines"))
    named = chunks.where("symbol is not null and symbol <> '' and not startswith(symbol, '<')").groupBy("file", "symbol").agg(F.min("start_line").alias("at"))
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("at", "symbol"))).where(F.col("r") <= most)
    lists = first.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "symbol"))), lambda x: x["symbol"]).alias("symbols"))
    return per_file.join(lists, "file", "left").select("file", "repo", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"), "lines")


def default_scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pluggable re-ranker interface (query, text) -> logit; this one scores the overlap of words."""
    for b in batches:
        q = [set(re.findall(r"[^ \t\n\f\r]+", str(x).lower())) for x in b["query"]]
        t = [set(re.findall(r"[^ \t\n\f\r]+", str(x).lower())) for x in b["text"]]
        share = np.array([len(x & y) / max(1, len(x)) for x, y in zip(q, t)])
        p = np.clip(share, 1e-7, 1 - 1e-7)
        b["logit"] = np.log(p / (1 - p))
        yield b
