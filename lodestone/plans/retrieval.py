"""Queries on lexical, vector and hybrid search, on packing and on the answer cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import ingest, rules
from ..operators import search as S
from ..sources.tables import table
from .ingest import DOCS, META, chunks, docs, meta
from .registry import Registry

R = Registry()


def tok_sql(c: str) -> str:
    """The tokens of a text: DuckDB's patterns know no look-ahead, so case changes are split first."""
    return f"list_transform(regexp_extract_all(regexp_replace({c}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))"


QUERIES = "(SELECT DISTINCT ON (item_id) item_id AS query_id, text FROM benchmark)"


def queries(spark, d):
    """One query per benchmark item: its whole text."""
    return table(spark, d, "benchmark", ["item_id", "text"]).dropDuplicates(["item_id"]).withColumnRenamed("item_id", "query_id")


_BM = f"""toks AS (SELECT doc_id AS id, {tok_sql('text')} AS ts FROM {DOCS} WHERE text IS NOT NULL), tk AS (SELECT * FROM toks WHERE len(ts) > 0),
po AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM tk) GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM {DOCS}) AS n, avg(len(ts)) AS avgdl FROM tk),
dfs AS (SELECT term, count(*) AS df, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM po GROUP BY term),
w AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM dfs) ELSE raw END AS idf FROM dfs)"""


def _scores(source: str) -> str:
    return f"""q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({tok_sql('text')}) AS term FROM {source}) GROUP BY ALL),
sc AS (SELECT query_id, id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM st)))) AS score FROM po JOIN q USING (term) JOIN w USING (term) GROUP BY ALL)"""


_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round({s}, 9) DESC, id) - 1"


def Lexical(spark, d) -> S.LexicalIndex:
    """The index of the documents, which are partitioned by their id."""
    return S.LexicalIndex.of(docs(spark, d).select(F.col("doc_id").alias("id"), "text"))


@R.add("tokenize_freq", f"SELECT term, count(*)::BIGINT AS n, count(DISTINCT id)::BIGINT AS documents FROM (SELECT doc_id AS id, unnest({tok_sql('text')}) AS term FROM {DOCS}) GROUP BY term")
def tokenize_freq(spark, d):
    t = docs(spark, d).select("doc_id", F.explode(T.search_tokens(F.col("text"))).alias("term"))
    return t.groupBy("term", "doc_id").agg(F.count("*").alias("c")).groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("documents"))


@R.add("bm25_corpus_stats", f"WITH {_BM} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM w")
def bm25_corpus_stats(spark, d):
    return Lexical(spark, d).weights.select("term", "df", F.round("idf", 6).alias("idf"))


@R.add("bm25_topk", f"WITH {_BM}, {_scores(QUERIES)} SELECT query_id, id, round(score, 6) AS score, rank0::INT AS rank0 FROM (SELECT *, {_RANK.format(s='score')} AS rank0 FROM sc) WHERE rank0 < 60")
def bm25_topk(spark, d):
    return Lexical(spark, d).search(queries(spark, d), fixed.CANDIDATE_POOL).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank0"))


@R.add("bm25_normalised", f"WITH {_BM}, {_scores(QUERIES)}, r AS (SELECT *, {_RANK.format(s='score')} AS rank0 FROM sc) SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS share FROM r WHERE rank0 < 60 AND score > 0")
def bm25_normalised(spark, d):
    r = Lexical(spark, d).search(queries(spark, d), fixed.CANDIDATE_POOL).where("score > 0")
    from pyspark.sql import Window

    return r.select("query_id", "id", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 6).alias("share"))


EMB = "(SELECT DISTINCT ON (vec_id) vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_VEC = f"""vs AS (SELECT q.id AS query_id, v.id AS id, round(list_dot_product(v.e, q.e), 9) AS sim FROM {EMB} v, {EMB} q WHERE q.id % 20 = 0),
vr AS (SELECT *, {_RANK.format(s='sim')} AS rank0 FROM vs), vec AS (SELECT * FROM vr WHERE rank0 < 60)"""


def vectors(spark, d):
    return table(spark, d, "embeddings", ["vec_id", "embedding", "label"]).dropDuplicates(["vec_id"]).withColumnRenamed("vec_id", "id")


def vector_queries(spark, d):
    """Every row whose id is divisible by 20 is a query against all rows."""
    return vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


def vector_lists(spark, d):
    return S.nearest(vectors(spark, d), vector_queries(spark, d), fixed.CANDIDATE_POOL)


@R.add("vector_topk", f"WITH {_VEC} SELECT query_id, id, round(sim, 5) + 0.0 AS sim, rank0::INT AS rank0 FROM vec")
def vector_topk(spark, d):
    return vector_lists(spark, d).select("query_id", "id", F.round("sim", 5).alias("sim"), "rank0")


@R.add("vector_norms", f"SELECT id, round(sqrt(list_dot_product(e, e)), 5) AS norm, round(e[1] / CASE WHEN list_dot_product(e, e) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END, 5) + 0.0 AS first_unit FROM {EMB}")
def vector_norms(spark, d):
    e = F.col("embedding")
    return vectors(spark, d).select("id", F.round(F.sqrt(T.dot(e, e)), 5).alias("norm"), F.round(F.element_at(T.unit(e), 1), 5).alias("first_unit"))


# For hybrid lists, a query is a document whose id is divisible by 20: its title and its vector.
_HQ = "(SELECT DISTINCT ON (doc_id) doc_id AS query_id, title AS text FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL AND doc_id IN (SELECT vec_id FROM embeddings))"
_LEX = f"{_BM}, {_scores(_HQ)}, lr AS (SELECT *, {_RANK.format(s='score')} AS rank0 FROM sc WHERE score > 0), lex AS (SELECT * FROM lr WHERE rank0 < 60)"
_FUSED = f"{_LEX}, {_VEC}, fu AS (SELECT query_id, id, sum(p) AS fused FROM (SELECT query_id, id, 0.5 / (60 + rank0) AS p FROM vec UNION ALL SELECT query_id, id, 0.5 / (60 + rank0) FROM lex) GROUP BY ALL)"


def hybrid_queries(spark, d):
    v = table(spark, d, "embeddings", ["vec_id"]).select(F.col("vec_id").alias("doc_id")).distinct()
    x = table(spark, d, "documents", ["doc_id", "title"]).where("doc_id % 20 = 0 and title is not null").dropDuplicates(["doc_id"]).join(v, "doc_id", "left_semi")
    return x.select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))


def lexical_lists(spark, d):
    q = hybrid_queries(spark, d)
    return Lexical(spark, d).search(q, fixed.CANDIDATE_POOL, positive=True)


def fused(spark, d):
    return S.fuse([(vector_lists(spark, d), fixed.HYBRID_ALPHA), (lexical_lists(spark, d), 1 - fixed.HYBRID_ALPHA)])


@R.add("hybrid_rrf", f"WITH {_FUSED} SELECT query_id, id, round(fused, 9) AS fused, rank0::INT AS rank0 FROM (SELECT *, {_RANK.format(s='fused')} AS rank0 FROM fu) WHERE rank0 < 60")
def hybrid_rrf(spark, d):
    """Vector and BM25 lists fused by reciprocal rank, with alpha as the vector's weight."""
    return S.ranked(fused(spark, d), "query_id", "fused", "id", fixed.CANDIDATE_POOL).select("query_id", "id", F.round("fused", 9).alias("fused"), "rank0")


_BOOST = f"bo AS (SELECT query_id, id, fused * CASE WHEN id % 7 = query_id % 7 THEN 2.0 ELSE 1.0 END * CASE WHEN id % 5 = query_id % 5 THEN 1.5 ELSE 1.0 END AS b FROM fu), br AS (SELECT *, {_RANK.format(s='b')} AS rank0 FROM bo)"


def boosted(spark, d):
    b = S.boost(F.col("fused"), F.col("id") % 7 == F.col("query_id") % 7, F.col("id") % 5 == F.col("query_id") % 5)
    return fused(spark, d).select("query_id", "id", b.alias("boosted"))


@R.add("boosted_fusion", f"WITH {_FUSED}, {_BOOST} SELECT query_id, id, round(b, 9) AS boosted, rank0::INT AS rank0 FROM br WHERE rank0 < 60")
def boosted_fusion(spark, d):
    """Multiplicative boosts for symbol hits (ids that agree modulo 7 stand for them) and path hits (modulo 5)."""
    return S.ranked(boosted(spark, d), "query_id", "boosted", "id", fixed.CANDIDATE_POOL).select("query_id", "id", F.round("boosted", 9).alias("boosted"), "rank0")


@R.add("late_interaction_fold", f"WITH {_FUSED}, ml AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id DESC) - 1 AS rank0 FROM vec), al AS (SELECT query_id, id, fused AS p FROM fu UNION ALL SELECT query_id, id, 0.4 / (60 + rank0) FROM ml) SELECT query_id, id, round(sum(p), 9) AS fused FROM al GROUP BY ALL")
def late_interaction_fold(spark, d):
    """A third list folded in with weight 0.4; here the vector list in another order."""
    from pyspark.sql import Window

    v = vector_lists(spark, d)
    other = v.select("query_id", "id").withColumn("rank0", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("id"))) - 1)
    f = S.fuse([(v, fixed.HYBRID_ALPHA), (lexical_lists(spark, d), 1 - fixed.HYBRID_ALPHA), (other, fixed.LATE_WEIGHT)])
    return f.select("query_id", "id", F.round("fused", 9).alias("fused"))


@R.add("relevance_floor", f"WITH {_FUSED} SELECT f.query_id, f.id, round(coalesce(v.sim, 0.5), 5) AS relevance FROM fu f LEFT JOIN vec v ON f.query_id = v.query_id AND f.id = v.id WHERE coalesce(v.sim, 0.5) >= 0.22")
def relevance_floor(spark, d):
    v = vector_lists(spark, d)
    j = S.fuse([(v, 0.5), (lexical_lists(spark, d), 0.5)]).join(v.select("query_id", "id", "sim"), ["query_id", "id"], "left")
    r = F.coalesce("sim", F.lit(0.5))
    return j.where(r >= fixed.MIN_RELEVANCE).select("query_id", "id", F.round(r, 5).alias("relevance"))


@R.add("crag_floor", f"WITH {_VEC}, s AS (SELECT query_id, id, 1 / (1 + exp(-4 * sim)) AS score FROM vec), m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM s), k AS (SELECT * FROM m WHERE score >= greatest(0.0, best * 0.6)), r AS (SELECT *, {_RANK.format(s='score')} AS rank0 FROM k) SELECT query_id, id, round(score, 6) AS score, rank0::INT AS rank0 FROM r WHERE rank0 < 30")
def crag_floor(spark, d):
    """Re-rank scores through a sigmoid, an adaptive floor relative to the best, and the top 30."""
    s = vector_lists(spark, d).select("query_id", "id", T.sigmoid(4 * F.col("sim")).alias("score"))
    return S.adaptive_floor(s, "query_id", "score", relative=0.6).select("query_id", "id", F.round("score", 6).alias("score"), "rank0")


_TOKS = "list_distinct(string_split_regex(trim(lower({c})), '\\s+'))"


@R.add(
    "rerank_overlap",
    f"""WITH {_BM}, {_scores(QUERIES)}, r AS (SELECT *, {_RANK.format(s='score')} AS rank0 FROM sc), c AS (SELECT r.query_id, r.id, list_filter({_TOKS.format(c='qq.text')}, lambda x: x <> '') AS a, list_filter({_TOKS.format(c='dd.text')}, lambda x: x <> '') AS b FROM r JOIN {QUERIES} qq ON r.query_id = qq.query_id JOIN {DOCS} dd ON r.id = dd.doc_id WHERE rank0 < 30),
p AS (SELECT query_id, id, least(greatest(len(list_intersect(a, b)) / greatest(1, len(a)), 1e-7), 1 - 1e-7) AS p FROM c) SELECT query_id, id, round(1 / (1 + exp(-ln(p / (1 - p)))), 6) AS relevance FROM p""",
)
def rerank_overlap(spark, d):
    """The plug-in point for re-rankers (an iterator over batches), with the default scorer."""
    q = queries(spark, d)
    r = Lexical(spark, d).search(q, fixed.RERANK_TOP).select("query_id", "id").join(q.withColumnRenamed("text", "query"), "query_id").join(docs(spark, d).select(F.col("doc_id").alias("id"), "text"), "id")
    scored = r.select("query_id", "id", "query", "text").mapInPandas(S.default_scorer, "query_id bigint, id bigint, query string, text string, logit double")
    return scored.select("query_id", "id", F.round(T.sigmoid(F.col("logit")), 6).alias("relevance"))


@R.add("maxsim_by_label", f"WITH s AS (SELECT q.id // 60 AS query_id, q.id AS pos, v.label AS doc, max(round(list_dot_product(v.e, q.e), 9)) AS m FROM {EMB} v, {EMB} q WHERE q.id % 20 = 0 GROUP BY ALL) SELECT query_id::BIGINT AS query_id, doc::BIGINT AS doc, round(sum(m), 5) AS score FROM s GROUP BY query_id, doc")
def maxsim_by_label(spark, d):
    """Late interaction with the rows of a label as a document's tokens and groups of query rows as a query's."""
    v = vectors(spark, d)
    q = v.where("id % 20 = 0").select(F.floor(F.col("id") / 60).cast("bigint").alias("query_id"), F.col("id").alias("pos"), "embedding")
    s = S.max_sim(v.select(F.col("label").cast("bigint").alias("doc"), "id", "embedding"), q)
    return s.select("query_id", "doc", F.round("score", 5).alias("score"))


@R.add("multi_query_rrf")
def multi_query_rrf(spark, d):
    """Every query in its variants, their BM25 lists fused with weight 1."""
    a = rules.analyse(queries(spark, d).withColumnRenamed("text", "query"))
    v = rules.variants(a).select((F.col("query_id") * 8 + F.col("variant")).alias("query_id"), "text")
    hits = Lexical(spark, d).search(v, fixed.CANDIDATE_POOL)
    f = S.fuse([(hits.withColumn("query_id", F.floor(F.col("query_id") / 8).cast("bigint")), 1.0)])
    return S.ranked(f, "query_id", "fused", "id", fixed.CANDIDATE_POOL).select("query_id", "id", F.round("fused", 9).alias("fused"), "rank0")


_HITS = f"""{_BM}, {_scores(QUERIES)}, r AS (SELECT *, {_RANK.format(s='score')} AS rank0 FROM sc), h AS (SELECT r.query_id, r.rank0, r.id, dd.source AS file FROM r JOIN {DOCS} dd ON r.id = dd.doc_id WHERE rank0 < 60)"""


@R.add("hits_per_file", f"WITH {_HITS} SELECT query_id, file, count(*)::BIGINT AS hits, min(rank0)::INT AS first_rank, arg_min(id, rank0) AS first_id FROM h WHERE file IS NOT NULL GROUP BY query_id, file")
def hits_per_file(spark, d):
    """Hits by group in the order of their first hit; a document's source stands for its file."""
    h = Lexical(spark, d).search(queries(spark, d), fixed.CANDIDATE_POOL).join(docs(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("file")).where("source is not null"), "id")
    return h.groupBy("query_id", "file").agg(F.count("*").alias("hits"), F.min("rank0").alias("first_rank"), F.min_by("id", "rank0").alias("first_id"))


_RG = f"(SELECT DISTINCT file, start_line, end_line, max(end_line) OVER (PARTITION BY file) AS last_line FROM {META})"


@R.add(
    "merge_ranges",
    f"""WITH p AS (SELECT DISTINCT file, greatest(1, start_line - 5) AS s, least(last_line, end_line - 12 + 5) AS e FROM {_RG} WHERE end_line - 12 >= start_line), w AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY s, e) AS isl FROM w) SELECT file, min(s)::INT AS start_line, max(e)::INT AS end_line FROM i GROUP BY file, isl""",
)
def merge_ranges(spark, d):
    """Ranges padded by five lines and merged where they touch."""
    from pyspark.sql import Window

    m = meta(spark, d, "file", "start_line", "end_line").withColumn("last_line", F.max("end_line").over(Window.partitionBy("file"))).withColumn("end_line", F.col("end_line") - 12).where("end_line >= start_line")
    return S.merge_ranges(m, pad=5)


_CB = f"""WITH c AS (SELECT chunk_id, file, start_line, end_line FROM {META}), p AS (SELECT DISTINCT ref_id AS point_id, file, line FROM refs WHERE file IS NOT NULL AND line IS NOT NULL),
x AS (SELECT point_id, chunk_id, line BETWEEN start_line AND end_line AS covers, row_number() OVER (PARTITION BY point_id ORDER BY (line BETWEEN start_line AND end_line) DESC, CASE WHEN line BETWEEN start_line AND end_line THEN 0 ELSE least(abs(line - start_line), abs(line - end_line)) END, start_line, chunk_id) AS r FROM p JOIN c USING (file))"""


@R.add("chunk_covering_line", _CB + " SELECT point_id, chunk_id, covers FROM x WHERE r = 1")
def chunk_covering_line(spark, d):
    p = table(spark, d, "refs", ["ref_id", "file", "line"]).where("file is not null and line is not null").select(F.col("ref_id").alias("point_id"), "file", "line").distinct()
    return S.covering_chunk(p, meta(spark, d, "file", "start_line", "end_line").select("chunk_id", "file", "start_line", "end_line"))


@R.add(
    "enclosing_symbol_asof",
    "WITH m AS (SELECT file, start_line, max(symbol) AS symbol FROM definitions GROUP BY file, start_line), p AS (SELECT DISTINCT ref_id, file, line FROM refs WHERE line IS NOT NULL) SELECT p.ref_id, p.file, p.line, m.symbol FROM p ASOF LEFT JOIN m ON p.file = m.file AND p.line >= m.start_line",
)
def enclosing_symbol_asof(spark, d):
    """The last declaration at or before each reference in its file."""
    p = table(spark, d, "refs", ["ref_id", "file", "line"]).where("line is not null").distinct()
    m = table(spark, d, "definitions", ["file", "start_line", "symbol"]).groupBy("file", F.col("start_line").alias("line")).agg(F.max("symbol").alias("symbol"))
    return S.last_before(p, m, "file", "line", "symbol")


@R.add("token_budget_prefix", f"WITH c AS (SELECT doc_id, doc_id // 10 AS query_id, doc_id % 10 AS pos, ceil(length(text) / 4)::BIGINT AS tokens FROM {DOCS} WHERE text IS NOT NULL), w AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM c) SELECT doc_id, query_id::BIGINT AS query_id, tokens, used::BIGINT AS used FROM w WHERE used <= 1500")
def token_budget_prefix(spark, d):
    x = docs(spark, d).where("text is not null").select("doc_id", F.floor(F.col("doc_id") / 10).cast("bigint").alias("query_id"), (F.col("doc_id") % 10).alias("pos"), T.estimated_tokens(F.col("text")).alias("tokens"))
    return S.budget_prefix(x, "query_id", ["pos"], "tokens", 1500).select("doc_id", "query_id", "tokens", "used")


@R.add("block_emission")
def block_emission(spark, d):
    """Context blocks of the windows found, under a budget: whole files first, then merged ranges, with mixed stop rules."""
    c = ingest.window_chunks(docs(spark, d).select("doc_id", "text")).select(F.xxhash64("doc_id", "chunk").alias("id"), "doc_id", "start_line", "end_line", "text")
    h = S.LexicalIndex.of(c.select("id", "text")).search(queries(spark, d), fixed.CANDIDATE_POOL)
    f = docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("file"), F.length("text").alias("file_chars"), F.size(T.lines(F.col("text"))).alias("last_line"), T.estimated_tokens(F.col("text")).alias("file_tokens"))
    j = h.join(c.drop("text"), "id").join(f, "doc_id").select("query_id", "rank0", "file", "file_chars", "start_line", "end_line", "last_line", "file_tokens")
    return S.emit_blocks(j, 6000, 30)


_MAP = f"""nm AS (SELECT file, symbol, min(start_line) AS first_line FROM {META} WHERE symbol IS NOT NULL AND symbol <> '' AND NOT starts_with(symbol, '<') GROUP BY file, symbol), rk AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY first_line, symbol) AS r FROM nm),
ls AS (SELECT file, list(symbol ORDER BY r) AS symbols FROM rk WHERE r <= 30 GROUP BY file), mp AS (SELECT p.file, p.repo, coalesce(ls.symbols, []) AS symbols, p.lines FROM (SELECT file, min(lower(repo)) AS repo, max(end_line) AS lines FROM {META} GROUP BY file) p LEFT JOIN ls USING (file))"""


@R.add("repo_map", f"WITH {_MAP} SELECT file, repo, symbols, lines FROM mp")
def repo_map(spark, d):
    return S.repo_map(meta(spark, d, "file", "repo", "symbol", "start_line", "end_line").withColumn("repo", F.lower("repo")))


@R.add(
    "repo_map_rank",
    f"""WITH {_MAP}, t AS (SELECT file, {tok_sql("file || ' ' || array_to_string(symbols, ' ')")} AS ts FROM mp), s AS (SELECT file, len(list_filter(ts, lambda x: x IN ('limit', 'session', 'parser')))::INT AS score FROM t) SELECT file, score FROM s WHERE score > 0 ORDER BY score DESC, file LIMIT 40""",
)
def repo_map_rank(spark, d):
    """Files of the map for the query "session parser limit", by the words of path and symbols."""
    m = repo_map(spark, d)
    ts = T.search_tokens(F.concat("file", F.lit(" "), F.array_join("symbols", " ")))
    return m.select("file", F.size(F.filter(ts, lambda x: x.isin("limit", "session", "parser"))).alias("score")).where("score > 0").orderBy(F.desc("score"), "file").limit(fixed.REPO_MAP_FILES)


# The answer cache: one entry per vector, written at minute vec_id, with its label as evidence.
_CACHE = f"(SELECT id, e, label, TIMESTAMP '2024-01-01' + to_minutes(id) AS ts FROM {EMB})"


def cache(spark, d):
    return vectors(spark, d).withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int))"))


@R.add("cache_lookup_best", f"WITH s AS (SELECT q.id AS query_id, c.id AS id, c.label, round(list_dot_product(c.e, q.e), 9) AS sim FROM {EMB} q, {_CACHE} c WHERE q.id % 20 = 0 AND c.id <> q.id), r AS (SELECT *, {_RANK.format(s='sim')} AS rank0 FROM s) SELECT query_id, id, round(sim, 5) AS sim, sim >= 0.8 AND label % 3 <> 0 AS hit FROM r WHERE rank0 = 0")
def cache_lookup_best(spark, d):
    """Only the best entry is looked at: similar enough, and its evidence (labels divisible by 3 are stale) unchanged."""
    n = S.nearest(vectors(spark, d), vector_queries(spark, d), 2).where("id <> query_id")
    best = S.ranked(n.drop("rank0"), "query_id", "sim", "id", 1).join(vectors(spark, d).select("id", "label"), "id")
    return best.select("query_id", "id", F.round("sim", 5).alias("sim"), ((F.col("sim") >= 0.8) & (F.col("label") % 3 != 0)).alias("hit"))


@R.add("cache_fifo_ttl", f"SELECT id, ts FROM {_CACHE} WHERE ts >= TIMESTAMP '2024-01-01 07:00:00' - INTERVAL 3600 SECOND ORDER BY ts DESC, id LIMIT 200")
def cache_fifo_ttl(spark, d):
    """Entries within the time to live at a given time, the newest 200."""
    return cache(spark, d).where("ts >= timestamp_ntz'2024-01-01 07:00:00' - interval 3600 seconds").select("id", "ts").orderBy(F.desc("ts"), "id").limit(fixed.CACHE_ENTRIES)


@R.add("cache_invalidate", f"SELECT id FROM {_CACHE} WHERE NOT list_contains(['label:' || label, 'row:' || (id % 10)], 'label:3') AND NOT list_contains(['label:' || label, 'row:' || (id % 10)], 'row:7')")
def cache_invalidate(spark, d):
    """Entries whose list of evidence doesn't name a changed file."""
    e = F.array(F.concat(F.lit("label:"), F.col("label").cast("string")), F.concat(F.lit("row:"), (F.col("id") % 10).cast("string")))
    return cache(spark, d).where(~F.arrays_overlap(e, F.array(F.lit("label:3"), F.lit("row:7")))).select("id")


@R.add("sigmoid_logit", f"SELECT id, round(1 / (1 + exp(-e[1] * 8)), 6) AS p, round(ln(least(greatest(abs(e[2]), 1e-7), 1 - 1e-7) / (1 - least(greatest(abs(e[2]), 1e-7), 1 - 1e-7))), 5) AS l FROM {EMB}")
def sigmoid_logit(spark, d):
    e = F.col("embedding")
    return vectors(spark, d).select("id", F.round(T.sigmoid(F.element_at(e, 1).cast("double") * 8), 6).alias("p"), F.round(T.logit(F.abs(F.element_at(e, 2).cast("double"))), 5).alias("l"))
