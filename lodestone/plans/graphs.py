"""Queries on the property graph, on rules and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import graph as G
from ..operators import rules
from ..sources.tables import table
from .ingest import DOCS, META, docs, meta, words_sql
from .registry import Registry

R = Registry()

NODES = "(SELECT DISTINCT id, kind, name, file, line, repo, created_at, removed_at FROM nodes)"
EDGES = "(SELECT DISTINCT edge_id, src_id, dst_id, kind, line, weight FROM edges)"


def nodes(spark, d):
    return table(spark, d, "nodes", ["id", "kind", "name", "file", "line", "repo", "created_at", "removed_at"]).distinct()


def edges(spark, d):
    return table(spark, d, "edges", ["edge_id", "src_id", "dst_id", "kind", "line", "weight"]).dropDuplicates(["edge_id"])


@R.add("edge_counts_by_kind", f"SELECT kind, count(*)::BIGINT AS n, count(DISTINCT src_id)::BIGINT AS sources FROM {EDGES} GROUP BY kind")
def edge_counts_by_kind(spark, d):
    return edges(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("src_id").alias("sources"))


@R.add("graph_latest_nodes", "SELECT id, arg_max(kind, (created_at, line, file)) AS kind, max(created_at) AS created_at FROM nodes GROUP BY id")
def graph_latest_nodes(spark, d):
    return G.latest_nodes(table(spark, d, "nodes")).select("id", "kind", "created_at")


_GONE = f"gone AS (SELECT DISTINCT id FROM {NODES} WHERE file LIKE '%/src/a%')"


@R.add("graph_delete_file", f"WITH {_GONE} SELECT kind, count(*)::BIGINT AS kept FROM {EDGES} e WHERE (src_id IS NULL OR src_id NOT IN (SELECT id FROM gone)) AND (dst_id IS NULL OR dst_id NOT IN (SELECT id FROM gone)) GROUP BY kind")
def graph_delete_file(spark, d):
    n = nodes(spark, d)
    _, kept = G.delete_file(n, edges(spark, d), n.where("file like '%/src/a%'"))
    return kept.groupBy("kind").agg(F.count("*").alias("kept"))


@R.add("find_definitions", f"SELECT id, name, file, line FROM {NODES} WHERE kind = 'Symbol' AND name IN ('get_logger', 'render', 'close') ORDER BY name, file, line, id LIMIT 200")
def find_definitions(spark, d):
    return nodes(spark, d).where("kind = 'Symbol' and name in ('get_logger', 'render', 'close')").select("id", "name", "file", "line").orderBy("name", "file", "line", "id").limit(200)


@R.add("edges_into_symbols", f"SELECT dst_id, kind, count(*)::BIGINT AS n FROM {EDGES} WHERE dst_id IS NOT NULL AND kind IN ('CALLS', 'TESTS') GROUP BY dst_id, kind")
def edges_into_symbols(spark, d):
    return edges(spark, d).where("dst_id is not null and kind in ('CALLS', 'TESTS')").groupBy("dst_id", "kind").agg(F.count("*").alias("n"))


@R.add("resolve_placeholders", f"SELECT e.edge_id, s.id AS resolved_id FROM {EDGES} e LEFT JOIN (SELECT DISTINCT id, name FROM {NODES} WHERE kind = 'Symbol') s ON substr(e.dst_id, 8) = s.name WHERE starts_with(e.dst_id, 'sym:?::')")
def resolve_placeholders(spark, d):
    return G.resolve_names(edges(spark, d), nodes(spark, d)).select("edge_id", "resolved_id")


_HOPS = f"""WITH RECURSIVE e AS (SELECT src_id AS s, dst_id AS t, max(weight) AS w FROM {EDGES} WHERE src_id IS NOT NULL AND dst_id IS NOT NULL AND kind IN ('CALLS', 'IMPORTS', 'DEFINES') GROUP BY ALL),
seed AS (SELECT DISTINCT id FROM {NODES} WHERE kind = 'File'),
h1 AS (SELECT seed.id AS seed, e.t AS id, max(e.w) AS weight FROM seed JOIN e ON e.s = seed.id WHERE e.t <> seed.id GROUP BY ALL),
h2 AS (SELECT h1.seed, e.t AS id, max(h1.weight + e.w) AS weight FROM h1 JOIN e ON e.s = h1.id WHERE e.t <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.id = e.t) GROUP BY ALL)"""


def hops(spark, d, n):
    """Walks from every File node.

    Repeated rows need no pass of their own: the seeds are made distinct, and of an edge's rows the largest weight counts.
    """
    s = table(spark, d, "nodes", ["id", "kind"]).where("kind = 'File'")
    s = s.select(F.col("id").alias("seed"), "id").distinct()
    e = table(spark, d, "edges", ["src_id", "dst_id", "kind", "weight"])
    return G.multi_hop(e, s, n, ["CALLS", "IMPORTS", "DEFINES"])


@R.add("multi_hop_1", _HOPS + " SELECT seed, id, 1 AS hop, round(weight, 6) AS weight FROM h1")
def multi_hop_1(spark, d):
    return hops(spark, d, 1).withColumn("weight", F.round("weight", 6))


@R.add("multi_hop_2", _HOPS + " SELECT seed, id, 1 AS hop, round(weight, 6) AS weight FROM h1 UNION ALL SELECT seed, id, 2, round(weight, 6) FROM h2")
def multi_hop_2(spark, d):
    return hops(spark, d, 2).withColumn("weight", F.round("weight", 6))


@R.add("tests_for_file", f"SELECT src_id, dst_id, 0.5::DOUBLE AS weight FROM (SELECT DISTINCT src_id, dst_id FROM {EDGES} WHERE kind = 'IMPORTS' AND src_id LIKE '%/tests/%' AND dst_id IS NOT NULL)")
def tests_for_file(spark, d):
    """Every import of a test file is a TESTS link of weight 0.5 as well."""
    return edges(spark, d).where("kind = 'IMPORTS' and src_id like '%/tests/%' and dst_id is not null").select("src_id", "dst_id", F.lit(0.5).alias("weight")).distinct()


REFS = "(SELECT DISTINCT ref_id, symbol, file, line, repo FROM refs)"
DEFS = "(SELECT DISTINCT symbol, file, kind, start_line FROM definitions)"


def refs(spark, d):
    return table(spark, d, "refs", ["ref_id", "symbol", "file", "line", "repo"]).dropDuplicates(["ref_id"])


def defs(spark, d):
    return table(spark, d, "definitions", ["symbol", "file", "kind", "start_line"]).distinct()


@R.add("callers_anti", f"SELECT ref_id, symbol, file, line FROM {REFS} r WHERE symbol IS NOT NULL AND file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {DEFS} x WHERE x.symbol = r.symbol AND x.file = r.file)")
def callers_anti(spark, d):
    return G.callers(refs(spark, d).where("symbol is not null and file is not null"), defs(spark, d)).select("ref_id", "symbol", "file", "line")


@R.add("refs_not_definitions", f"SELECT ref_id FROM {REFS} r WHERE NOT EXISTS (SELECT 1 FROM {DEFS} x WHERE x.symbol = r.symbol AND x.start_line = r.line)")
def refs_not_definitions(spark, d):
    s = defs(spark, d).select("symbol", F.col("start_line").alias("line")).distinct()
    return refs(spark, d).join(s, ["symbol", "line"], "left_anti").select("ref_id")


_CALLEES = f"""SELECT c.chunk_id, r.symbol, x.kind, x.file AS def_file, x.start_line AS def_line FROM {META} c JOIN {REFS} r ON r.file = c.file AND r.line BETWEEN c.start_line AND c.end_line JOIN {DEFS} x ON x.symbol = r.symbol AND x.file <> r.file"""


@R.add("callees_join", f"SELECT symbol, kind, count(DISTINCT (chunk_id, def_file, def_line))::BIGINT AS links FROM ({_CALLEES}) GROUP BY symbol, kind")
def callees_join(spark, d):
    """Chunks by what they refer to in other files, counted per symbol.

    Repeated rows need no pass of their own: links are of distinct chunks and definitions.
    """
    r = table(spark, d, "refs", ["symbol", "file", "line"])
    x = table(spark, d, "definitions", ["symbol", "file", "kind", "start_line"])
    return G.callee_links(r, x, table(spark, d, "store_meta", ["chunk_id", "file", "start_line", "end_line"]))


IMPORTS = "(SELECT DISTINCT import_id, file, target, line, repo FROM imports)"


def imports(spark, d):
    return table(spark, d, "imports", ["import_id", "file", "target", "line", "repo"]).dropDuplicates(["import_id"]).drop("import_id")


@R.add("importers_like", f"SELECT part, file, target, line, repo FROM {IMPORTS}, (SELECT unnest(['json', 'cursor', 'os', 'fold_model', 's']) AS part) WHERE contains(target, part)")
def importers_like(spark, d):
    parts = spark.createDataFrame([("json",), ("cursor",), ("os",), ("fold_model",), ("s",)], "part string")
    return G.importers(imports(spark, d), parts)


@R.add(
    "neighbours_union",
    f"""WITH a AS (SELECT DISTINCT r.symbol AS key, 'caller' AS relation, 0 AS p, r.file, r.line, r.symbol FROM {REFS} r WHERE r.symbol IN ('get_logger', 'render', 'close', 'handle') AND r.file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {DEFS} x WHERE x.symbol = r.symbol AND x.file = r.file)
UNION SELECT DISTINCT symbol, 'callee', 1, file, start_line, symbol FROM {DEFS} WHERE symbol IN ('get_logger', 'render', 'close', 'handle') UNION SELECT DISTINCT 'render', 'importer', 2, file, line, target FROM {IMPORTS} WHERE contains(target, 'json'))
SELECT key, relation, file, line, symbol, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, file, line NULLS FIRST, symbol) AS pos FROM a) WHERE pos <= 12""",
)
def neighbours_union(spark, d):
    """Callers, then callees, then importers around a symbol; the first twelve."""
    names = ["get_logger", "render", "close", "handle"]
    a = G.callers(refs(spark, d).where(F.col("symbol").isin(*names) & F.col("file").isNotNull()), defs(spark, d)).select(F.col("symbol").alias("key"), "file", "line", "symbol")
    b = defs(spark, d).where(F.col("symbol").isin(*names)).select(F.col("symbol").alias("key"), "file", F.col("start_line").alias("line"), "symbol")
    c = G.importers(imports(spark, d), spark.createDataFrame([("json",)], "part string")).select(F.lit("render").alias("key"), "file", "line", F.col("target").alias("symbol"))
    return G.neighbours(a, b, c, fixed.NEIGHBOUR_LIMIT).select("key", "relation", "file", "line", "symbol", "pos")


# Query texts with every branch of the rules, made of the benchmark by the id.
_QCASE = [
    ("how does {w} work in parse_tree and IndexWriter?", 0), ("what is this repo about {w}", 1), ("find \"{w}\" in the code", 2), ("update the file src/app/main.py with {w}", 3), ("config/settings.yaml {w}", 4),
    ("resolveHandle {w}", 5), ("why is {w} failing with an error", 6), ("implement a {w} queue for the scheduler please", 7), ("clean up MAX_RETRY {w} and the loops of the loader now", 8), ("{w} readme section of the harbour", 9), ("load_graph needs the {w} cache of nodes and edges soon", 10),
]
_W = "regexp_extract(text, '([a-z]{6,})', 1)"
_QSQL = "CASE item_id % 11 " + " ".join(f"WHEN {k} THEN replace('{t}', '{{w}}', {_W})" for t, k in _QCASE) + " END"
QT = f"(SELECT item_id AS query_id, {_QSQL} AS query FROM (SELECT DISTINCT ON (item_id) item_id, text FROM benchmark))"


def query_texts(spark, d):
    b = table(spark, d, "benchmark", ["item_id", "text"]).dropDuplicates(["item_id"])
    w = F.regexp_extract("text", "([a-z]{6,})", 1)
    q = F.coalesce(*[F.when(F.col("item_id") % 11 == k, F.replace(F.lit(t), F.lit("{w}"), w)) for t, k in _QCASE])
    return b.select(F.col("item_id").alias("query_id"), q.alias("query"))


_PROSE = words_sql(fixed.PROSE_WORDS)
_IS_SYMBOL = f"(length(x) >= 3 AND lower(x) NOT IN ({_PROSE}) AND (contains(regexp_replace(x, '^_+|_+$', '', 'g'), '_') OR (upper(x) = x AND regexp_matches(x, '[A-Z]')) OR regexp_matches(x, '{fixed.MIXED_CASE}')))"
_AN = f"""p0 AS (SELECT query_id, query, trim(query) AS q, list_sort(list_distinct(list_filter(regexp_extract_all(trim(query), '{fixed.PATH_MENTION}'), lambda x: NOT starts_with(x, '.')))) AS f, string_split_regex(lower(trim(query)), '[^a-z0-9_]+') AS ws FROM {QT}),
p1 AS (SELECT *, list_concat(f, list_filter([{words_sql(sorted(fixed.KNOWN_FILES))}], lambda x: list_contains(ws, x) AND NOT list_contains(f, x))) AS paths FROM p0),
p2 AS (SELECT *, CASE WHEN len(paths) >= 1 THEN replace(CASE WHEN len(paths) >= 2 THEN replace(q, paths[2], ' ') ELSE q END, paths[1], ' ') ELSE q END AS bare FROM p1),
p3 AS (SELECT *, regexp_extract_all(bare, '{fixed.IDENTIFIER}') AS t FROM p2),
p4 AS (SELECT *, list_filter(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN list_position(t, t[i]) = i THEN t[i] END), lambda x: x IS NOT NULL AND {_IS_SYMBOL}) AS symbols, list_sum(list_concat([0.0], list_transform(t, lambda x: CASE WHEN {_IS_SYMBOL} THEN 0.0 WHEN lower(x) IN ({_PROSE}) THEN 1.0 ELSE 0.5 END))) AS prose FROM p3),
an AS (SELECT *, CASE WHEN q = '' THEN 0.5 WHEN len(symbols) > 0 AND prose <= 1 THEN 0.25 WHEN len(symbols) > 0 AND len(symbols) >= prose * 0.7 THEN 0.4 WHEN len(symbols) = 0 THEN 0.7 ELSE 0.5 END AS alpha, len(symbols) > 0 AND len(symbols) >= prose * 0.7 AS symbol_dominant FROM p4)"""


@R.add("query_analysis", f"WITH {_AN} SELECT query_id, paths, symbols, round(prose::DOUBLE, 3) AS prose, round(alpha::DOUBLE, 3) AS alpha, symbol_dominant FROM an")
def query_analysis(spark, d):
    return rules.analyse(query_texts(spark, d)).select("query_id", "paths", "symbols", F.round("prose", 3).alias("prose"), F.round("alpha", 3).alias("alpha"), "symbol_dominant")


def _any(c: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({c}, '" + p.replace("'", "''") + "')" for p in phrases) + ")"


_ROUTE = f"""ro AS (SELECT *, lower(q) AS l, len(list_filter(string_split_regex(lower(q), '\\s+'), lambda x: x <> '')) AS n FROM an), rt AS (SELECT query_id, CASE WHEN n <= 12 AND {_any('l', fixed.OVERVIEW_PHRASES)} THEN 'OVERVIEW' WHEN contains(q, '"') OR contains(q, '''') THEN 'EXACT_STRING'
 WHEN {_any('l', fixed.WRITE_PHRASES)} AND len(paths) >= 1 THEN 'WRITE_FILE' WHEN len(paths) >= 1 AND n <= 10 AND NOT contains(l, '?') AND NOT {_any('l', fixed.HOW_PHRASES)} AND NOT {_any('l', fixed.DEBUG_PHRASES)} THEN 'FILE_LOOKUP'
 WHEN len(symbols) >= 1 AND n <= 6 AND NOT {_any('l', fixed.HOW_PHRASES)} AND NOT {_any('l', fixed.DEBUG_PHRASES)} THEN 'SYMBOL_LOOKUP' WHEN {_any('l', fixed.DEBUG_PHRASES)} THEN 'DEBUG' WHEN {_any('l', fixed.IMPLEMENT_PHRASES)} THEN 'IMPLEMENT_FEATURE'
 WHEN {_any('l', fixed.REFACTOR_PHRASES)} THEN 'REFACTOR' WHEN {_any('l', fixed.HOW_PHRASES)} OR len(symbols) = 0 THEN 'HOW_X_WORKS' ELSE 'DEFAULT' END AS route FROM ro)"""
_PLANS = ", ".join(f"('{k}', {str(v[0]).lower()}, {str(v[1]).lower()}, '{v[2]}', {v[3]}, {v[4]})" for k, v in fixed.ROUTE_PLANS.items())


@R.add("route_classify", f"WITH {_AN}, {_ROUTE} SELECT query_id, rt.route, use_hyde, use_multi_query, seed_strategy, top_k, seed_budget FROM rt JOIN (VALUES {_PLANS}) AS p(route, use_hyde, use_multi_query, seed_strategy, top_k, seed_budget) ON rt.route = p.route")
def route_classify(spark, d):
    return rules.route(rules.analyse(query_texts(spark, d))).select("query_id", "route", "use_hyde", "use_multi_query", "seed_strategy", "top_k", "seed_budget")


@R.add("multi_query_variants")
def multi_query_variants(spark, d):
    return rules.variants(rules.analyse(query_texts(spark, d)))


@R.add(
    "confidence_policy",
    f"""WITH s AS (SELECT doc_id, (doc_id % 101)::DOUBLE / 100 AS t, (doc_id % 53)::DOUBLE / 100 AS u, doc_id % 2 = 0 AS a, doc_id % 3 = 0 AS b, doc_id % 5 = 0 AS g, doc_id % 7 = 0 AS r, doc_id % 6 AS f, doc_id % 4 AS k, doc_id % 11 = 0 AS sh, CASE WHEN doc_id % 13 = 0 THEN 'DEBUG' END AS intent FROM {DOCS}),
c AS (SELECT *, 0.5 * least(1.0, greatest(0.0, t)) + 0.1 * least(1.0, greatest(0.0, t - u) * 4) + CASE WHEN a THEN 0.15 ELSE 0 END + CASE WHEN b THEN 0.08 ELSE 0 END + CASE WHEN g THEN 0.05 ELSE 0 END + CASE WHEN r THEN 0.05 ELSE 0 END + CASE WHEN f >= 3 THEN 0.05 ELSE 0 END AS s0 FROM s),
x AS (SELECT *, least(1.0, greatest(0.0, CASE WHEN k = 0 THEN least(s0, 0.10) ELSE s0 END - CASE WHEN sh THEN 0.05 ELSE 0 END)) AS score FROM c)
SELECT doc_id, round(score::DOUBLE, 6) AS score, CASE WHEN round(score, 6) <= 0.10 AND k = 0 THEN 'ASK_CLARIFY' WHEN round(score, 6) >= 0.72 AND coalesce(intent, '') = 'DEBUG' THEN 'ONE_MORE_ROUND' WHEN round(score, 6) >= 0.72 THEN 'ANSWER_NOW' WHEN round(score, 6) >= 0.30 THEN 'ONE_MORE_ROUND' ELSE 'AGENTIC_SEARCH' END AS policy FROM x""",
)
def confidence_policy(spark, d):
    i = F.col("doc_id")
    s = docs(spark, d).select(
        "doc_id", ((i % 101) / 100).alias("t"), ((i % 53) / 100).alias("u"), (i % 2 == 0).alias("a"), (i % 3 == 0).alias("b"), (i % 5 == 0).alias("g"), (i % 7 == 0).alias("r"), (i % 6).alias("f"), (i % 4).alias("k"), (i % 11 == 0).alias("sh"), F.when(i % 13 == 0, "DEBUG").alias("intent")
    )
    c = F.round(rules.confidence(*[F.col(x) for x in ("t", "u", "a", "b", "g", "r", "f", "k", "sh")]), 6)
    return s.withColumn("score", c).select("doc_id", "score", rules.policy(F.col("score"), F.col("k"), F.col("intent")).alias("policy"))


@R.add("intent_boosts", f"SELECT chunk_type, intent, round((count(*) * coalesce(boost, 1.0))::DOUBLE, 3) AS weighted FROM (SELECT chunk_id, chunk_type FROM {META} WHERE chunk_type IS NOT NULL) CROSS JOIN (SELECT unnest(['DEBUG', 'OVERVIEW', 'DEFAULT']) AS intent) LEFT JOIN (VALUES {', '.join(str(x) for x in fixed.INTENT_BOOSTS)}) AS b(i, c, boost) ON b.i = intent AND b.c = chunk_type GROUP BY chunk_type, intent, boost")
def intent_boosts(spark, d):
    """How an intent weighs the classes of chunks."""
    b = F.create_map(*[F.lit(x) for i, c, w in fixed.INTENT_BOOSTS for x in (f"{i}/{c}", w)])
    m = meta(spark, d, "chunk_type").where("chunk_type is not null").groupBy("chunk_type").agg(F.count("*").alias("n"))
    x = m.withColumn("intent", F.explode(F.array(F.lit("DEBUG"), F.lit("OVERVIEW"), F.lit("DEFAULT"))))
    return x.select("chunk_type", "intent", F.round(F.col("n") * F.coalesce(F.element_at(b, F.concat_ws("/", "intent", "chunk_type")), F.lit(1.0)), 3).alias("weighted"))


# Conversations made of documents: five in a row are one, even turns are the user's.
TURNS = f"(SELECT doc_id // 5 AS conv_id, doc_id % 5 AS turn, CASE WHEN doc_id % 5 % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, CASE WHEN doc_id % 15 = 0 THEN 'fix it here' ELSE text END AS text FROM {DOCS} WHERE text IS NOT NULL)"


def turns(spark, d):
    i = F.col("doc_id")
    return docs(spark, d).where("text is not null").select(
        F.floor(i / 5).cast("bigint").alias("conv_id"), (i % 5).alias("turn"), F.when(i % 5 % 2 == 0, "user").otherwise("assistant").alias("role"), F.when(i % 15 == 0, "fix it here").otherwise(F.col("text")).alias("text")
    )


@R.add("last_user_query", f"SELECT conv_id::BIGINT AS conv_id, max(turn) AS turn, length(arg_max(text, turn))::INT AS chars FROM {TURNS} WHERE role = 'user' GROUP BY conv_id")
def last_user_query(spark, d):
    return turns(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.length(F.max_by("text", "turn")).alias("chars"))


@R.add(
    "conversation_enrich",
    rf"""WITH w AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la FROM {TURNS}),
u AS (SELECT *, trim(text) AS q, list_transform(regexp_extract_all(coalesce(la, ''), '(?s)```(?:[\w+-]+)?\n(.*?)```', 1), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))) AS code, list_slice(list_filter(list_transform(string_split(coalesce(la, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND regexp_matches(x, '{fixed.INTERESTING_LINE}')), 1, 30) AS tl FROM w WHERE role = 'user'),
p AS (SELECT *, list_filter(list_concat(code, CASE WHEN len(tl) > 0 THEN [array_to_string(tl, chr(10))] ELSE [] END), lambda x: x <> '') AS parts FROM u),
e AS (SELECT *, CASE WHEN la IS NULL OR la = '' THEN '' ELSE trim(substr(CASE WHEN len(parts) > 0 THEN array_to_string(parts, chr(10) || chr(10)) ELSE right(la, 600) END, 1, 600), ' ' || chr(10) || chr(9) || chr(13)) END AS ex FROM p),
f AS (SELECT *, ex <> '' AND ((length(q) <= 40 AND regexp_matches(q, '{fixed.PRONOUNS}')) OR len(list_filter(string_split_regex(lower(q), '[^a-z0-9_]+'), lambda x: length(x) > 4 AND x NOT IN ({words_sql(fixed.CONTEXT_STOP)}) AND contains(lower(ex), x))) > 0) AS enriched FROM e)
SELECT conv_id::BIGINT AS conv_id, turn, enriched, md5(CASE WHEN enriched THEN text || chr(10) || chr(10) || 'Previous assistant context for retrieval:' || chr(10) || ex ELSE text END) AS query_md5 FROM f""",
)
def conversation_enrich(spark, d):
    return rules.enrich(turns(spark, d)).select("conv_id", "turn", "enriched", F.md5("query").alias("query_md5"))


_EDITED = f"(SELECT doc_id, text || CASE WHEN doc_id % 9 = 0 THEN ' Return only the code.' WHEN doc_id % 14 = 0 THEN ' <original_code>' ELSE '' END AS text FROM {DOCS} WHERE text IS NOT NULL)"


@R.add("edit_apply_detect", f"SELECT doc_id, {_any('text', fixed.EDIT_TAGS)} OR {_any('lower(text)', fixed.EDIT_PHRASES)} AS is_edit FROM {_EDITED}")
def edit_apply_detect(spark, d):
    x = docs(spark, d).where("text is not null")
    t = F.concat("text", F.when(F.col("doc_id") % 9 == 0, " Return only the code.").when(F.col("doc_id") % 14 == 0, " <original_code>").otherwise(""))
    return x.select("doc_id", rules.is_edit_request(t).alias("is_edit"))


_NAMES = ["atlas-core", "atlas", "river-sync", "river", "quartz"]


@R.add("repo_scope_mask")
def repo_scope_mask(spark, d):
    """Repositories named in the sources and texts, the longest name first."""
    x = docs(spark, d).where("text is not null")
    return x.select("doc_id", rules.mentioned_names(F.concat_ws(" ", F.translate(F.coalesce("source", F.lit("")), ".", " "), "text"), _NAMES).alias("names"))
