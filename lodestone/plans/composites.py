"""Queries on whole pipelines: retrieval, graph building, sessions, answers, stores and tools."""

from __future__ import annotations

import ast
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import ingest as O
from ..operators import retrieve as RT
from ..operators import search as S
from ..operators.syntax_chunks import python_chunks, references
from ..session import ensure_checkpoint_dir
from ..sources.store import VersionedTable
from .graphs import TURNS, _any, query_texts, turns
from .ingest import DOCS, META, docs, meta, numbered
from .registry import Registry
from ..sources.tables import table
from .retrieval import _BM, _RANK, QUERIES, Lexical, _scores, queries

R = Registry()


def text_chunks(spark, d):
    m = meta(spark, d, "file", "symbol", "doc", "start_line", "end_line").where("doc is not null")
    return m.select(F.xxhash64("chunk_id").alias("id"), "file", "symbol", F.col("doc").alias("text"), "start_line", "end_line", T.estimated_tokens(F.col("doc")).alias("tokens"))


@R.add("retrieve_batch")
def retrieve_batch(spark, d):
    """The whole retrieval of a batch of queries over the chunks of store_meta."""
    return RT.retrieve(query_texts(spark, d), text_chunks(spark, d)).withColumn("score", F.round("score", 9))


@R.add("graph_expansion")
def graph_expansion(spark, d):
    """What the call graph adds to the hits of a batch of queries."""
    from .graphs import defs, refs

    c = text_chunks(spark, d)
    ranked = RT.retrieve(query_texts(spark, d), c, top=10).select("query_id", "id", F.col("pos").alias("rank0"), "score")
    return RT.expand_with_graph(ranked, c, refs(spark, d), defs(spark, d)).withColumn("score", F.round("score", 9))


@R.add("graph_build")
def graph_build(spark, d):
    """Nodes and edges of all files: definitions, imports, inheritance, calls and tests, counted by kind."""
    n = numbered(spark, d)
    de, im, he = O.definitions(n), O.imports(n), O.inheritance(n)
    m = meta(spark, d, "file", "doc", "start_line", "end_line")
    use = references(m).join(de.select("symbol").distinct(), "symbol", "left_semi")
    own = de.select("file", F.col("line"), "symbol").distinct()
    calls = S.last_before(use.withColumnRenamed("symbol", "name").join(own.withColumnRenamed("symbol", "name"), ["file", "line", "name"], "left_anti"), own, "file", "line", "symbol")
    edges = (
        de.select(F.concat(F.lit("file:"), "file").alias("src_id"), F.concat(F.lit("sym:"), "file", F.lit("::"), "symbol").alias("dst_id"), F.lit("DEFINES").alias("kind"), F.lit(1.0).alias("weight"))
        .unionByName(im.select(F.concat(F.lit("file:"), "file").alias("src_id"), F.concat(F.lit("module:"), "target").alias("dst_id"), F.lit("IMPORTS").alias("kind"), F.lit(1.0).alias("weight")))
        .unionByName(im.where(F.col("file").rlike(fixed.TEST_PATH)).select(F.concat(F.lit("file:"), "file").alias("src_id"), F.concat(F.lit("module:"), "target").alias("dst_id"), F.lit("TESTS").alias("kind"), F.lit(0.5).alias("weight")))
        .unionByName(he.select(F.concat(F.lit("sym:"), "file", F.lit("::"), "child").alias("src_id"), F.concat(F.lit("sym:?::"), "parent").alias("dst_id"), F.lit("INHERITS").alias("kind"), F.lit(1.0).alias("weight")))
        .unionByName(calls.select(F.concat(F.lit("sym:"), "file", F.lit("::"), F.coalesce("symbol", F.lit("?"))).alias("src_id"), F.concat(F.lit("sym:?::"), "name").alias("dst_id"), F.lit("CALLS").alias("kind"), F.lit(1.0).alias("weight")))
    )
    return edges.distinct().groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("src_id").alias("sources"), F.round(F.sum("weight"), 3).alias("weight"))


@R.add("chunk_router", f"SELECT file, CASE WHEN ends_with(file, '.py') THEN 'syntax' ELSE 'window' END AS way, count(DISTINCT chunk_id)::BIGINT AS stored FROM {META} GROUP BY file")
def chunk_router(spark, d):
    """Which chunker a file goes to; files that the syntax chunker can't parse fall back to windows inside it."""
    m = meta(spark, d, "file")
    return m.groupBy("file", F.when(F.col("file").endswith(".py"), "syntax").otherwise("window").alias("way")).agg(F.countDistinct("chunk_id").alias("stored"))


@R.add("syntax_chunk_kinds")
def syntax_chunk_kinds(spark, d):
    c = python_chunks(meta(spark, d, "file", "doc", "start_line", "end_line"))
    kind = F.when(F.col("symbol").isNull(), "window").when(F.col("symbol").startswith("<"), "header").when(F.col("symbol").startswith("class "), "class").when(F.col("symbol").contains("."), "method").otherwise("function")
    return c.groupBy(kind.alias("kind")).agg(F.count("*").alias("chunks"))


_FILE_REF = r"[`\s\[]([A-Za-z][A-Za-z0-9_./\\-]+\.[A-Za-z]{2,5})\b"


@R.add(
    "session_context",
    f"""WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM {TURNS} WHERE role = 'assistant'), s AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS x FROM t WHERE r <= 4 GROUP BY conv_id),
m AS (SELECT conv_id, regexp_extract_all(x, '{_FILE_REF}', 1) AS l FROM s) SELECT conv_id::BIGINT AS conv_id, list_slice(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END), lambda x: x IS NOT NULL), 1, 10) AS files FROM m""",
)
def session_context(spark, d):
    """Files named in the last assistant turns of each conversation (at most four turns, ten files)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = turns(spark, d).where("role = 'assistant'").withColumn("r", F.row_number().over(w)).where("r <= 4")
    s = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("x"))
    return s.select("conv_id", F.slice(F.array_distinct(F.regexp_extract_all("x", F.lit(_FILE_REF), F.lit(1))), 1, 10).alias("files"))


_EV = "list_sort(list_distinct(list_transform(regexp_extract_all({c}, '" + fixed.EVIDENCE_PATH.replace("'", "''") + "'), lambda x: replace(x, '\\', '/'))))"


@R.add(
    "evidence_choice",
    f"WITH a AS (SELECT doc_id, {_EV.format(c='text')} AS p, {_EV.format(c="coalesce(title, '')")} AS q FROM (SELECT DISTINCT ON (doc_id) doc_id, text, title FROM documents) WHERE text IS NOT NULL) SELECT doc_id, list_slice(CASE WHEN len(list_intersect(p, q)) > 0 THEN list_sort(list_intersect(p, q)) WHEN len(p) > 0 THEN p ELSE q END, 1, 30) AS evidence FROM a",
)
def evidence_choice(spark, d):
    """Paths of an answer (a document) that its seed (the document's title) names as well, else whichever side has any."""
    def paths(c):
        return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(fixed.EVIDENCE_PATH), F.lit(0)), lambda x: F.translate(x, "\\", "/"))))

    x = table(spark, d, "documents", ["doc_id", "text", "title"]).where("text is not null").dropDuplicates(["doc_id"]).select("doc_id", paths(F.col("text")).alias("p"), paths(F.coalesce("title", F.lit(""))).alias("q"))
    both = F.array_sort(F.array_intersect("p", "q"))
    return x.select("doc_id", F.slice(F.when(F.size(both) > 0, both).when(F.size("p") > 0, F.col("p")).otherwise(F.col("q")), 1, 30).alias("evidence"))


@R.add("cacheable_answers", f"SELECT doc_id, length(trim(text)) >= 20 AND NOT (starts_with(lower(trim(text)), 'error:') OR starts_with(lower(trim(text)), '(no ') OR starts_with(lower(trim(text)), 'i don''t')) AS cacheable FROM {DOCS} WHERE text IS NOT NULL")
def cacheable_answers(spark, d):
    t = F.trim("text")
    return docs(spark, d).where("text is not null").select("doc_id", ((F.length(t) >= 20) & ~(F.lower(t).startswith("error:") | F.lower(t).startswith("(no ") | F.lower(t).startswith("i don't"))).alias("cacheable"))


@R.add("message_parts", f"SELECT doc_id, md5('begin ' || coalesce(source, '')) AS text_md5 FROM {DOCS}")
def message_parts(spark, d):
    """Messages that come as text or as a JSON list of parts, brought to text."""
    x = docs(spark, d).withColumn("s", F.coalesce("source", F.lit("")))
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("begin "), "s")).otherwise(F.to_json(F.array(F.struct(F.lit("begin ").alias("text")), F.struct(F.col("s").alias("text")))))
    parts = F.from_json("raw", "array<struct<text:string>>")
    text = F.when(F.col("raw").startswith("["), F.array_join(F.transform(parts, lambda p: p["text"]), "")).otherwise(F.col("raw"))
    return x.withColumn("raw", raw).select("doc_id", F.md5(text).alias("text_md5"))


@R.add("block_format", f"SELECT chunk_id, md5('### [' || coalesce(lower(repo), '') || '] `' || file || '`' || chr(10) || '**Lines:** ' || start_line || '-' || end_line || CASE WHEN symbol IS NOT NULL THEN ' | **Symbol:** `' || symbol || '`' ELSE '' END || chr(10) || chr(10) || '```' || chr(10) || doc || chr(10) || '```') AS block_md5 FROM {META} WHERE doc IS NOT NULL")
def block_format(spark, d):
    m = meta(spark, d, "repo", "file", "start_line", "end_line", "symbol", "doc").where("doc is not null")
    head = F.concat(F.lit("### ["), F.coalesce(F.lower("repo"), F.lit("")), F.lit("] `"), "file", F.lit("`\n**Lines:** "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.coalesce(F.concat(F.lit(" | **Symbol:** `"), "symbol", F.lit("`")), F.lit("")))
    return m.select("chunk_id", F.md5(F.concat(head, F.lit("\n\n```\n"), "doc", F.lit("\n```"))).alias("block_md5"))


def _sections(x, text):
    x = x.select(F.col("doc_id").alias("query_id"), F.lower(text).alias("l"))
    how, debug = T.any_phrase(F.col("l"), fixed.HOW_PHRASES), T.any_phrase(F.col("l"), fixed.DEBUG_PHRASES)
    lists = [F.array(*[F.lit(x) for x in s]) for s in (["map", "retrieval"], ["map", "retrieval", "changes"], ["retrieval"])]
    return x.select("query_id", F.when(how, lists[0]).when(debug, lists[1]).otherwise(lists[2]).alias("sections"))


@R.add("seed_sections", f"WITH q AS (SELECT doc_id AS query_id, lower(coalesce(text, '')) AS l FROM {DOCS}) SELECT query_id, CASE WHEN {_any('l', fixed.HOW_PHRASES)} THEN ['map', 'retrieval'] WHEN {_any('l', fixed.DEBUG_PHRASES)} THEN ['map', 'retrieval', 'changes'] ELSE ['retrieval'] END AS sections FROM q")
def seed_sections(spark, d):
    """Sections of a prompt by what its whole text asks for."""
    return _sections(docs(spark, d), F.coalesce("text", F.lit("")))


@R.add("versioned_store", f"SELECT count(DISTINCT chunk_id)::BIGINT AS chunks, 2::BIGINT AS versions FROM {META} WHERE hash < '8'")
def versioned_store(spark, d):
    """Two versions of a table written; the last one is read."""
    t = VersionedTable(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    m = meta(spark, d, "hash").select("chunk_id", "hash")
    t.write(m, "all")
    t.write(m.where("hash < '8'"), "part")
    return t.read().agg(F.countDistinct("chunk_id").alias("chunks")).withColumn("versions", F.lit(len(t.versions())).cast("bigint"))


@R.add("fenced_python_check")
def fenced_python_check(spark, d):
    """Fenced Python blocks of documents by whether they parse."""
    @F.pandas_udf("boolean")
    def parses(body: pd.Series) -> pd.Series:
        def one(x: str) -> bool:
            try:
                ast.parse(x)
            except (SyntaxError, ValueError, RecursionError):
                return False
            return True

        return body.map(one)

    b = docs(spark, d).where("text is not null").select("doc_id", F.posexplode(T.fenced_blocks(F.col("text"))).alias("pos", "b")).where("b.lang = 'python' and b.body <> ''")
    return b.select("doc_id", "pos", parses(F.col("b.body")).alias("parses"))


@R.add("fuse_reversed_lists", f"WITH {_BM}, {_scores(QUERIES)} SELECT query_id, id, rank0::INT AS rank0 FROM (SELECT *, {_RANK.format(s='score')} AS rank0 FROM sc) WHERE rank0 < 60")
def fuse_reversed_lists(spark, d):
    """A list fused with itself gives its own order again."""
    h = Lexical(spark, d).search(queries(spark, d), fixed.CANDIDATE_POOL)
    return S.ranked(S.fuse([(h, 0.5), (h, 0.5)]), "query_id", "fused", "id").select("query_id", "id", "rank0")
