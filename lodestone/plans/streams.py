"""Queries on event streams and on evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import evaluation as E
from ..sources.tables import table
from ..streaming import events as S
from .registry import Registry
from .retrieval import _BM, _RANK, QUERIES, Lexical, _scores, queries

R = Registry()

EV = "(SELECT DISTINCT ON (event_id) event_id, ts, user_id, event_type, value FROM events)"
_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark, d):
    return table(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "value"]).dropDuplicates(["event_id"])


@R.add("event_filter", f"SELECT event_id, kind FROM (SELECT event_id, unnest(CASE event_type WHEN 'signup' THEN ['modified'] WHEN 'purchase' THEN ['deleted', 'modified'] WHEN 'error' THEN ['deleted'] WHEN 'click' THEN ['modified'] ELSE [] END) AS kind FROM {EV})")
def event_filter(spark, d):
    """Event types stand for created, moved, deleted and modified files: created counts as modified, moved as both, others go."""
    kinds = F.when(F.col("event_type") == "signup", F.array(F.lit("modified"))).when(F.col("event_type") == "purchase", F.array(F.lit("deleted"), F.lit("modified"))).when(F.col("event_type") == "error", F.array(F.lit("deleted"))).when(F.col("event_type") == "click", F.array(F.lit("modified")))
    return events(spark, d).select("event_id", F.explode(kinds).alias("kind"))


@R.add("storm_detection", f"SELECT event_id, n::BIGINT AS n, n >= 3 AS storm FROM (SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW) AS n FROM {EV})")
def storm_detection(spark, d):
    return S.trailing_counts(events(spark, d), 600).select("event_id", "n", (F.col("n") >= 3).alias("storm"))


# Pointers from each event to the first one at least an hour later, followed from the first event of a key.
_NEXT = """f AS MATERIALIZED (SELECT k, ts, min(event_id) AS event_id FROM {source} GROUP BY k, ts),
nx AS MATERIALIZED (SELECT e.event_id, f.event_id AS nxt FROM f e ASOF JOIN f ON e.k = f.k AND e.ts + INTERVAL 1 HOUR <= f.ts),
acc(event_id) AS (SELECT arg_min(event_id, ts) FROM f GROUP BY k UNION ALL SELECT nx.nxt FROM acc JOIN nx ON nx.event_id = acc.event_id)"""
_DEBOUNCED = f"WITH RECURSIVE {_NEXT.format(source=f'(SELECT event_id, ts, user_id AS k FROM {EV} WHERE user_id IS NOT NULL)')} SELECT event_id, user_id::BIGINT AS user_id FROM acc JOIN {EV} e USING (event_id)"


@R.add("debounce_paths", _DEBOUNCED)
def debounce_paths(spark, d):
    return S.debounce(events(spark, d), "user_id", 3600).select("event_id", F.col("user_id").cast("bigint").alias("user_id"))


@R.add(
    "rebuild_sessions",
    f"WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM {EV}), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM g) SELECT user_id, min(ts) AS start_ts, count(*)::BIGINT AS n_events FROM s GROUP BY user_id, i",
)
def rebuild_sessions(spark, d):
    """One rebuild per burst of events of a key."""
    return S.sessions(events(spark, d), "user_id", 7200).select(F.col("user_id").cast("bigint").alias("user_id"), F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "n_events")


_HOT = f"hot AS MATERIALIZED (SELECT event_id, ts, 0 AS k FROM (SELECT event_id, ts, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW) AS n FROM {EV}) WHERE n >= 3)"


@R.add("storm_gate", f"WITH RECURSIVE {_HOT}, {_NEXT.format(source='hot')} SELECT event_id, ts FROM acc JOIN {EV} e USING (event_id)")
def storm_gate(spark, d):
    """Pauses of the indexer: three events within ten minutes begin one of an hour."""
    return S.storm_pauses(events(spark, d), 600, 3, 3600).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@R.add("head_change", f"SELECT event_id, user_id, event_type AS after, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {EV}) WHERE before IS NOT NULL AND before <> event_type")
def head_change(spark, d):
    """Event types stand for observed heads of a repository (the user)."""
    e = events(spark, d).withColumn("at", F.struct("ts", "event_id"))
    return S.changes(e, "user_id", "at", "event_type").select("event_id", "user_id", F.col("event_type").alias("after"), "before")


@R.add("tumbling_counts", f"SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start_ts, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM {EV} GROUP BY ALL")
def tumbling_counts(spark, d):
    g = events(spark, d).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.col("w.start").alias("start_ts"), "n", "total")


@R.add("sliding_counts", f"SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start_ts, count(*)::BIGINT AS n FROM {EV}, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def sliding_counts(spark, d):
    return events(spark, d).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start_ts"), "n")


@R.add("ttl_expiry", f"SELECT event_type, count(*)::BIGINT AS expired FROM {EV} WHERE TIMESTAMP '2024-01-15' - ts > INTERVAL 3600 SECOND GROUP BY event_type")
def ttl_expiry(spark, d):
    e = events(spark, d).where("timestamp_ntz'2024-01-15 00:00:00' - ts > interval 3600 seconds")
    return e.groupBy("event_type").agg(F.count("*").alias("expired"))


def _stream(spark, d):
    """events as a stream; the Parquet file is seen through its folder."""
    return spark.readStream.schema(_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(d)


@R.add("stream_tumbling", f"SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start_ts, count(*)::BIGINT AS n FROM {EV} GROUP BY ALL")
def stream_tumbling(spark, d):
    s = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    g = s.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start_ts"), "n")
    return S.run_to_end(g, "tumbling", "complete")


@R.add("stream_filter", f"SELECT event_id, event_type FROM {EV} WHERE event_type IN ('click', 'error')")
def stream_filter(spark, d):
    s = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes").where("event_type in ('click', 'error')").dropDuplicatesWithinWatermark(["event_id"])
    return S.run_to_end(s.select("event_id", "event_type"), "filter")


@R.add("stream_debounce", _DEBOUNCED)
def stream_debounce(spark, d):
    return S.run_to_end(S.debounce_stream(_stream(spark, d), "user_id", 3600), "debounce").select("event_id", F.col("user_id").cast("bigint").alias("user_id"))


@R.add(
    "stream_sessions",
    "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id::BIGINT AS user_id, min(ts) AS start_ts, count(*)::BIGINT AS n_events FROM s GROUP BY user_id, i HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
)
def stream_sessions(spark, d):
    """Bursts that the watermark, ten minutes behind the last event, has passed."""
    s = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    x = S.run_to_end(S.session_stream(s, "user_id", "2 hours"), "sessions")
    return x.select(F.col("user_id").cast("bigint").alias("user_id"), F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), "n_events")


@R.add("stream_upsert", f"SELECT user_id, count(*)::BIGINT AS n FROM (SELECT DISTINCT user_id, event_type FROM {EV}) GROUP BY user_id")
def stream_upsert(spark, d):
    """Micro-batches merged into a table of versions by key."""
    import uuid

    from ..session import ensure_checkpoint_dir

    target = f"{ensure_checkpoint_dir(spark)}/upsert-{uuid.uuid4().hex}"
    t = S.upsert_stream(_stream(spark, d).select("user_id", "event_type"), target, ["user_id", "event_type"], "q")
    return t.groupBy("user_id").agg(F.count("*").alias("n"))


# Evaluation: a benchmark item is a case; the documents whose id agrees with it modulo 240 are to be cited, the BM25 list is what was cited.
_CASES = f"""WITH {_BM}, {_scores(QUERIES)}, ci AS (SELECT * FROM (SELECT query_id AS case_id, id, {_RANK.format(s='score')} AS rank0 FROM sc) WHERE rank0 < 60),
go AS (SELECT item_id AS case_id, doc_id AS id FROM (SELECT DISTINCT item_id FROM benchmark) b JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id % 240 = b.item_id % 240),
rs AS (SELECT go.case_id, count(*) AS wanted, count(ci.id) AS found, min(ci.rank0) AS first FROM go LEFT JOIN ci ON go.case_id = ci.case_id AND go.id = ci.id GROUP BY go.case_id),
ms AS (SELECT case_id, found / wanted AS recall, coalesce(1.0 / (first + 1), 0.0) AS rr, found > 0 AS passed, case_id % 37 + (case_id % 10) / 10.0 AS latency FROM rs)"""


def cases(spark, d):
    """Metrics per case; every document is wanted by the case that agrees with its id."""
    cited = Lexical(spark, d).search(queries(spark, d), fixed.CANDIDATE_POOL).select(F.col("query_id").alias("case_id"), "id", "rank0")
    b = table(spark, d, "benchmark", ["item_id"]).distinct().select(F.col("item_id").alias("case_id"), (F.col("item_id") % 240).alias("k"))
    g = table(spark, d, "documents", ["doc_id"]).distinct().select(F.col("doc_id").alias("id"), (F.col("doc_id") % 240).alias("k"))
    return E.case_metrics(b.join(g, "k").select("case_id", "id"), cited).withColumn("latency", F.col("case_id") % 37 + (F.col("case_id") % 10) / 10)


def _recall_mrr(c):
    return c.select("case_id", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"), "passed")


@R.add("eval_recall_mrr", _CASES + " SELECT case_id, round(recall, 6) AS recall, round(rr, 6) AS rr, passed FROM ms")
def eval_recall_mrr(spark, d):
    return _recall_mrr(cases(spark, d))


@R.add("eval_summary", _CASES + " SELECT count(*)::BIGINT AS n, count(*) FILTER (passed)::BIGINT AS passed, round(avg(recall), 3) AS recall, round(avg(rr), 3) AS mrr, round(quantile_cont(latency, 0.5), 3) AS p50, round(quantile_cont(latency, 0.95), 3) AS p95 FROM ms")
def eval_summary(spark, d):
    return E.summary(cases(spark, d))


def _regressions(c):
    now = c.select("case_id", "passed", "recall")
    before = now.select("case_id", (F.col("case_id") % 2 == 0).alias("passed"), F.lit(0.5).alias("recall"))
    return E.regressions(before, now).withColumn("recall_change", F.round("recall_change", 6))


@R.add("eval_regressions", _CASES + ", pr AS (SELECT case_id, case_id % 2 = 0 AS passed, 0.5 AS recall FROM ms) SELECT ms.case_id, round(ms.recall - pr.recall, 6) AS recall_change FROM ms JOIN pr USING (case_id) WHERE pr.passed AND NOT ms.passed")
def eval_regressions(spark, d):
    """Against a former run, in which the even cases passed."""
    return _regressions(cases(spark, d))


@R.add("eval_phrases", "SELECT item_id, contains(lower(text), 'smallest number') AS has_wanted, contains(lower(text), 'velvet') AS has_forbidden FROM (SELECT DISTINCT item_id, text FROM benchmark)")
def eval_phrases(spark, d):
    b = table(spark, d, "benchmark", ["item_id", "text"]).distinct()
    return b.select("item_id", F.lower("text").contains("smallest number").alias("has_wanted"), F.lower("text").contains("velvet").alias("has_forbidden"))


@R.add("eval_tags", "SELECT item_id FROM (SELECT DISTINCT item_id, suite FROM benchmark) WHERE list_has_any(string_split(suite, '-'), ['puzzle', 'x'])")
def eval_tags(spark, d):
    b = table(spark, d, "benchmark", ["item_id", "suite"]).distinct()
    return b.where(F.arrays_overlap(F.split("suite", "-"), F.array(F.lit("puzzle"), F.lit("x")))).select("item_id")


@R.add("rank_margin", f"WITH {_BM}, {_scores(QUERIES)}, r AS (SELECT *, {_RANK.format(s='score')} AS rank0 FROM sc) SELECT query_id, round(max(CASE WHEN rank0 = 0 THEN score END) - coalesce(max(CASE WHEN rank0 = 1 THEN score END), 0), 6) + 0.0 AS margin FROM r WHERE rank0 < 2 GROUP BY query_id")
def rank_margin(spark, d):
    r = Lexical(spark, d).search(queries(spark, d), 2)
    w = Window.partitionBy("query_id").orderBy("rank0")
    return r.withColumn("next", F.lead("score").over(w)).where("rank0 = 0").select("query_id", F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 6).alias("margin"))
