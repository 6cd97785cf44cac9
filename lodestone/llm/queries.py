"""Queries of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import Registry
from . import handwritten, neighbours, packing
from ..session import spread
from ..sources.tables import table
from .files import per_file, windows
from .leaks import find_leaks, leak_locations, leaked_per_item, without_leaks
from .neighbours import similar_pairs
from .sentences import sentence_rows

R = Registry()


def _documents(spark, d):
    return spread(table(spark, d, "documents", ["doc_id", "text"]), "doc_id")


@R.add("p1_found")
def p1_found(spark, d):
    return handwritten.not_handwritten(windows(spark, d)).select("file")


@R.add("p1_reasons")
def p1_reasons(spark, d):
    """Files, by repository and reason, that a person didn't write there."""
    return handwritten.not_handwritten(windows(spark, d)).groupBy("repo", "reason").agg(F.count("*").alias("files"))


@R.add("p4_found")
def p4_found(spark, d):
    from .credentials import find_credentials, lines_of

    def visit(file, text):
        return [(n,) for n in lines_of(text, find_credentials(text))]

    return per_file(windows(spark, d), [("line", "int")], visit).select("file", "line")


@R.add("p4_masked")
def p4_masked(spark, d):
    """The doc of every chunk, with its credentials masked and all else unchanged."""
    from .credentials import find_credentials, mask

    def visit(file, text):
        spans = find_credentials(text)
        if not spans:
            return []
        old, new = text.split("\n"), mask(text, spans).split("\n")
        return [(i, b) for i, (a, b) in enumerate(zip(old, new), 1) if a != b]

    lines = per_file(windows(spark, d), [("line", "int"), ("masked", "string")], visit).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("line", "masked"))).alias("masks"))
    chunks = table(spark, d, "store_meta", ["chunk_id", "file", "start_line", "end_line", "doc"]).dropDuplicates(["chunk_id"])
    j = chunks.join(lines, "file", "left")
    doc = F.array_join(F.transform(F.split("doc", "\n"), lambda x, i: F.coalesce(F.try_element_at("masks", (F.col("start_line") + i).cast("int")), x)), "\n")
    return j.select("chunk_id", F.when(F.col("masks").isNull(), F.col("doc")).otherwise(doc).alias("doc"))


@R.add("p9_found")
def p9_found(spark, d):
    return find_leaks(_documents(spark, d), table(spark, d, "benchmark", ["item_id", "text"]))


@R.add("p9_items")
def p9_items(spark, d):
    """How many documents carry each leaked item."""
    return leaked_per_item(find_leaks(_documents(spark, d), table(spark, d, "benchmark", ["item_id", "text"])))


@R.add("p9_locations")
def p9_locations(spark, d):
    """The longest verbatim match of each leaked item in each document, with its place."""
    return leak_locations(_documents(spark, d), table(spark, d, "benchmark", ["item_id", "text"])).distinct()


@R.add("p9_clean")
def p9_clean(spark, d):
    """Ids of the documents that are left when those with a leaked item are removed."""
    leaks = find_leaks(_documents(spark, d), table(spark, d, "benchmark", ["item_id", "text"]))
    return without_leaks(table(spark, d, "documents", ["doc_id"]).distinct(), leaks)


@R.add("p6_found")
def p6_found(spark, d):
    return similar_pairs(table(spark, d, "vector_store", ["vec_id", "embedding"]))


@R.add("p6_search")
def p6_search(spark, d):
    """Greedy graph search: every vector whose id is divisible by 20 as a query against all vectors, its five best with their similarity."""
    usable = neighbours.usable_vectors(table(spark, d, "vector_store", ["vec_id", "embedding"]))
    packed = neighbours.pack(usable)
    index = neighbours.build_index(packed)
    queries = packed.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return neighbours.search(index, queries).select("query_id", "vec_id", F.round("sim", 9).alias("similarity"))


@R.add("p10_found")
def p10_found(spark, d):
    return sentence_rows(_documents(spark, d)).distinct()


@R.add("p10_per_language")
def p10_per_language(spark, d):
    """How many sentences, and of how many characters, the documents of each label hold."""
    docs = spread(table(spark, d, "documents", ["doc_id", "text", "lang"]), "doc_id")
    rows = sentence_rows(docs).distinct().join(docs.select("doc_id", "lang").dropDuplicates(["doc_id"]), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("sentences"), F.round(F.avg(F.col("end_pos") - F.col("start_pos")), 6).alias("mean_chars"))


def _file_tokens(spark, d):
    """file, repo, language group, domain and tokens of every file."""
    from .files import language_group
    from .tokens import file_domain, load_counter

    shared = spark.sparkContext.broadcast(load_counter())  # bounded by the vocabulary

    def visit(file, text):
        return [(file_domain(file), language_group(None, file), shared.value.text(text), len(text))]

    return per_file(windows(spark, d), [("domain", "string"), ("by_file", "string"), ("tokens", "bigint"), ("chars", "bigint")], visit)


@R.add("p3_tokens")
def p3_tokens(spark, d):
    """Files, characters and estimated tokens per repository, language and domain."""
    t = _file_tokens(spark, d)
    return t.groupBy(F.coalesce("repo", F.lit("unknown")).alias("repo"), F.col("by_file").alias("language"), "domain").agg(
        F.count("*").alias("files"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens")
    )


def _packed(spark, d):
    return packing.pack(packing.token_sizes(_documents(spark, d)), table(spark, d, "container_sizes", ["container", "capacity_tokens"]))


@R.add("p8_pack")
def p8_pack(spark, d):
    return _packed(spark, d)


@R.add("p8_fill")
def p8_fill(spark, d):
    return packing.fill_report(_packed(spark, d), table(spark, d, "container_sizes", ["container", "capacity_tokens"]))


def _syntax(spark, d):
    """file, repo, language, line (null if valid) and found text of every file with a grammar."""
    from .syntax import extension, first_error

    def visit(file, text):
        ext = extension(file)
        if ext is None:
            return []
        line, found = first_error(file, text) or (None, None)
        return [(ext, line, found)]

    return per_file(windows(spark, d), [("ext", "string"), ("line", "int"), ("found", "string")], visit)


@R.add("p2_found")
def p2_found(spark, d):
    return _syntax(spark, d).where("line is not null").select("file")


@R.add("p2_rates")
def p2_rates(spark, d):
    """Files and invalid files per repository and language."""
    s = _syntax(spark, d)
    return s.groupBy("repo", F.col("ext").alias("language")).agg(F.count("*").alias("files"), F.count("line").alias("invalid"), F.round(F.count("line") / F.count("*"), 6).alias("rate"))
