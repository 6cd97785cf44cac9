"""Rules on queries and conversations as column expressions: analysis, routes, variants, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def analyse(queries: DataFrame) -> DataFrame:
    """queries(query_id, query) -> with paths, symbols, prose, alpha, symbol_dominant. Null and blank queries: alpha 0.5, empty lists."""
    q = queries.withColumn("_q", F.trim(F.coalesce("query", F.lit(""))))
    q = q.withColumn("paths", T.path_mentions(F.col("_q")))
    bare = F.aggregate("paths", F.col("_q"), lambda acc, p: F.replace(acc, p, F.lit(" ")))
    q = q.withColumn("_t", F.regexp_extract_all(bare, F.lit(fixed.IDENTIFIER), F.lit(0)))
    symbols = F.array_distinct(F.filter("_t", T.looks_like_symbol))
    weight = F.aggregate("_t", F.lit(0.0), lambda acc, t: acc + F.when(T.looks_like_symbol(t), 0.0).when(T.in_words(F.lower(t), fixed.PROSE_WORDS), 1.0).otherwise(0.5))
    q = q.withColumn("symbols", symbols).withColumn("prose", weight)
    n = F.size("symbols")
    dominant = (n > 0) & (n >= F.col("prose") * 0.7)
    alpha = F.when(F.col("_q") == "", 0.5).when((n > 0) & (F.col("prose") <= 1), 0.25).when(dominant, 0.4).when(n == 0, 0.7).otherwise(0.5)
    return q.withColumn("alpha", alpha).withColumn("symbol_dominant", dominant).drop("_q", "_t")


def route(analysed: DataFrame) -> DataFrame:
    """The first route whose rule holds, and its plan."""
    q = F.trim(F.coalesce("query", F.lit("")))
    low = F.lower(q)
    words = F.size(F.filter(F.split(low, r"\s+"), lambda x: x != ""))
    how, debug = T.any_phrase(low, fixed.HOW_PHRASES), T.any_phrase(low, fixed.DEBUG_PHRASES)
    paths, symbols = F.size("paths"), F.size("symbols")
    name = (
        F.when((words <= 12) & T.any_phrase(low, fixed.OVERVIEW_PHRASES), "OVERVIEW")
        .when(q.contains('"') | q.contains("'"), "EXACT_STRING")
        .when(T.any_phrase(low, fixed.WRITE_PHRASES) & (paths >= 1), "WRITE_FILE")
        .when((paths >= 1) & (words <= 10) & ~low.contains("?") & ~how & ~debug, "FILE_LOOKUP")
        .when((symbols >= 1) & (words <= 6) & ~how & ~debug, "SYMBOL_LOOKUP")
        .when(debug, "DEBUG")
        .when(T.any_phrase(low, fixed.IMPLEMENT_PHRASES), "IMPLEMENT_FEATURE")
        .when(T.any_phrase(low, fixed.REFACTOR_PHRASES), "REFACTOR")
        .when(how | (symbols == 0), "HOW_X_WORKS")
        .otherwise("DEFAULT")
    )
    plan = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(*[F.lit(v) for v in x]) for kv in fixed.ROUTE_PLANS.items() for x in kv])
    p = F.element_at(plan, F.col("route"))
    return analysed.withColumn("route", name).select("*", *[p[f"col{i}"].alias(c) for i, c in enumerate(["use_hyde", "use_multi_query", "seed_strategy", "top_k", "seed_budget"], 1)])


def variants(analysed: DataFrame, most: int = 3) -> DataFrame:
    """One row per variant of a query: the query, topic, symbols in context, key words, or a hinted suffix."""
    q = F.trim(F.coalesce("query", F.lit("")))
    words = T.content_words(q)
    topic = F.substring(F.array_join(F.filter(words, lambda w: ~w.rlike(r"^\d+$")), " "), 1, 120)
    low_symbols = F.transform("symbols", F.lower)
    context = F.coalesce(F.try_element_at(F.filter(words, lambda w: ~F.array_contains(low_symbols, w) & (F.length(w) > 3)), F.lit(1)), F.lit(""))
    paired = F.trim(F.concat(F.array_join(F.slice("symbols", 1, 3), " "), F.lit(" "), context))
    keys = F.array_join(F.slice(words, 1, 5), " ")
    base = F.concat(
        F.array(q),
        F.when((topic != "") & (F.lower(topic) != F.lower(q)), F.array(F.concat(topic, F.lit(" implementation")))).otherwise(F.array().cast("array<string>")),
        F.when((F.size("symbols") > 0) & (F.lower(paired) != F.lower(q)), F.array(paired)).otherwise(F.array().cast("array<string>")),
        F.when((F.size(words) >= 2) & (F.lower(keys) != F.lower(q)), F.array(keys)).otherwise(F.array().cast("array<string>")),
    )
    d = analysed.withColumn("_b", base).withColumn("_w", words)
    hint = F.element_at(F.array(*[F.lit(x) for x in fixed.SUFFIX_HINTS]), F.pmod(F.size("_b"), F.lit(len(fixed.SUFFIX_HINTS))) + 1)
    more = F.concat(F.array_join(F.slice("_w", 1, 6), " "), F.lit(" "), hint)
    full = F.when((F.size("_b") < most) & (F.size("_w") > 0), F.concat("_b", F.array(more))).otherwise(F.col("_b"))
    # once per wording, whatever the case; the first stays
    once = F.aggregate(full, F.array().cast("array<string>"), lambda acc, v: F.when(F.exists(acc, lambda a: F.lower(F.trim(a)) == F.lower(F.trim(v))), acc).otherwise(F.concat(acc, F.array(v))))
    return d.select("query_id", F.posexplode(F.slice(once, 1, most)).alias("variant", "text"))


def confidence(top: Column, second: Column, symbol: Column, path: Column, graph: Column, recent: Column, files: Column, blocks: Column, short: Column) -> Column:
    s = 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), top)) + 0.1 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), top - second) * 4)
    for flag, w in ((symbol, 0.15), (path, 0.08), (graph, 0.05), (recent, 0.05), (files >= 3, 0.05)):
        s = s + F.when(flag, w).otherwise(0.0)
    s = F.when(blocks == 0, F.least(s, F.lit(0.10))).otherwise(s)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s - F.when(short, 0.05).otherwise(0.0)))


def policy(score: Column, blocks: Column, intent: Column) -> Column:
    return (
        F.when((score <= fixed.CLARIFY) & (blocks == 0), "ASK_CLARIFY")
        .when((score >= fixed.ANSWER_NOW) & (F.coalesce(intent, F.lit("")) == "DEBUG"), "ONE_MORE_ROUND")
        .when(score >= fixed.ANSWER_NOW, "ANSWER_NOW")
        .when(score >= fixed.AGENTIC, "ONE_MORE_ROUND")
        .otherwise("AGENTIC_SEARCH")
    )


def excerpt(answer: Column, most: int = 600) -> Column:
    """What of an answer helps to find things: its fenced code, its telling lines, else its end."""
    code = F.transform(F.regexp_extract_all(answer, F.lit(r"(?s)```(?:[\w+-]+)?\n(.*?)```"), F.lit(1)), lambda x: F.trim(x, F.lit(" \n\t\r")))
    telling = F.slice(F.filter(F.transform(T.lines(answer), lambda x: F.trim(x)), lambda x: (x != "") & x.rlike(fixed.INTERESTING_LINE)), 1, 30)
    parts = F.filter(F.concat(code, F.when(F.size(telling) > 0, F.array(F.array_join(telling, "\n"))).otherwise(F.array().cast("array<string>"))), lambda x: x != "")
    said = F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise(F.substring(answer, -most, most))
    return F.trim(F.substring(said, 1, most), F.lit(" \n\t\r"))


def enrich(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text): every user turn with the excerpt of the last assistant turn before it, where it refers back."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t = turns.withColumn("_last", F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(w)).where("role = 'user'")
    q = F.trim(F.coalesce("text", F.lit("")))
    t = t.withColumn("_x", F.when(F.col("_last").isNotNull() & (F.col("_last") != ""), excerpt(F.col("_last"))).otherwise(F.lit("")))
    vague = (F.length(q) <= 40) & q.rlike(fixed.PRONOUNS)
    tokens = F.filter(F.split(F.lower(q), r"[^a-z0-9_]+"), lambda x: (F.length(x) > 4) & ~T.in_words(x, fixed.CONTEXT_STOP))
    shares = F.exists(tokens, lambda x: F.lower("_x").contains(x))
    used = (F.col("_x") != "") & (vague | shares)
    return t.select("conv_id", "turn", used.alias("enriched"), F.when(used, F.concat(F.col("text"), F.lit("\n\nPrevious assistant context for retrieval:\n"), F.col("_x"))).otherwise(F.col("text")).alias("query"))


def is_edit_request(text: Column) -> Column:
    return T.any_phrase(text, fixed.EDIT_TAGS) | T.any_phrase(F.lower(text), fixed.EDIT_PHRASES)


def mentioned_names(text: Column, names: list[str]) -> Column:
    """Names in a text, longest first; a found name is masked so that a shorter one inside it doesn't count."""
    order = sorted(names, key=lambda n: (-len(n), n))
    start = F.struct(F.lower(text).alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, n: Column) -> Column:
        hit = acc["rest"].contains(F.lower(n))
        return F.when(hit, F.struct(F.replace(acc["rest"], F.lower(n), F.lit(" ")).alias("rest"), F.concat(acc["found"], F.array(n)).alias("found"))).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(n) for n in order]), start, step, lambda acc: acc["found"])
