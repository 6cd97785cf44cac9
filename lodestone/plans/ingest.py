"""Queries on sources, chunks, extraction and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import ingest as I
from ..sources.tables import table
from .registry import Registry

R = Registry()


def words_sql(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def _sql(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


#: One row per chunk of store_meta, without repeats.
META = "(SELECT DISTINCT chunk_id, doc, file, filename, repo, language, start_line, end_line, symbol, chunk_type, hash FROM store_meta)"
SUFFIX_SQL = r"lower(regexp_extract(regexp_extract(replace({f}, '\', '/'), '([^/]*)$', 1), '\.([^.]*)$', 1))"
LANG_SQL = "coalesce(map_extract_value(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.LANGUAGE_BY_SUFFIX.items()) + "}, {s}), {s})"


def lang_sql(f: str) -> str:
    return LANG_SQL.replace("{s}", SUFFIX_SQL.replace("{f}", f))


def meta(spark, d, *cols):
    return table(spark, d, "store_meta", ["chunk_id", *[c for c in cols if c != "chunk_id"]]).dropDuplicates(["chunk_id"])


def docs(spark, d):
    """documents without repeats."""
    return table(spark, d, "documents", ["doc_id", "text", "lang", "source", "n_chars"]).dropDuplicates(["doc_id"])


DOCS = "(SELECT DISTINCT ON (doc_id) doc_id, text, lang, source, n_chars FROM documents)"

# Names for the noise filter: made of the id, so that every branch is met.
_NOISE_NAME_SQL = "CASE doc_id % 6 WHEN 0 THEN 'a/b' || doc_id || '.min.js' WHEN 1 THEN 'a/package-lock.json' WHEN 2 THEN 'a/x' || doc_id || '.js.map' ELSE 'a/f' || doc_id || '.md' END"


@R.add(
    "noise_filter_reasons",
    f"SELECT doc_id, CASE WHEN name IN ({words_sql(fixed.IGNORED_NAMES)}) THEN 'ignored name' WHEN "
    + " OR ".join(f"ends_with(lower(name), '{x}')" for x in fixed.IGNORED_ENDINGS)
    + f" THEN 'ignored suffix' WHEN n_chars IS NULL THEN 'unreadable' WHEN n_chars > {fixed.MAX_FILE_BYTES} THEN 'too large' WHEN n_chars = 0 THEN 'empty' END AS reason FROM (SELECT doc_id, n_chars, regexp_extract({_NOISE_NAME_SQL}, '([^/]*)$', 1) AS name FROM {DOCS})",
)
def noise_filter_reasons(spark, d):
    x = docs(spark, d).withColumn("file", F.expr(_NOISE_NAME_SQL))
    return x.select("doc_id", I.noise_reason(F.col("file"), F.col("n_chars")).alias("reason"))


@R.add(
    "discover_files",
    f"SELECT DISTINCT file, {SUFFIX_SQL.replace('{f}', 'file')} AS suffix FROM store_meta WHERE {SUFFIX_SQL.replace('{f}', 'file')} IN ({words_sql(fixed.INDEXED_SUFFIXES)}) "
    f"AND NOT list_has_any(list_slice(string_split(replace(file, '\\', '/'), '/'), 1, -2), [{words_sql(fixed.IGNORED_DIRS)}])",
)
def discover_files(spark, d):
    f = table(spark, d, "store_meta", ["file"]).where("file is not null").distinct()
    return f.where(I.indexable(F.col("file"))).select("file", T.suffix(F.col("file")).alias("suffix"))


@R.add("language_by_suffix", f"SELECT language, count(*)::BIGINT AS files FROM (SELECT DISTINCT file, {lang_sql('file')} AS language FROM store_meta) GROUP BY language")
def language_by_suffix(spark, d):
    return table(spark, d, "store_meta", ["file"]).distinct().groupBy(T.language_of(F.col("file")).alias("language")).agg(F.count("*").alias("files"))


@R.add("path_parts", r"SELECT DISTINCT file, regexp_extract(file, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\.[^.]*$', '') AS stem, regexp_replace(lower(file), '^(?:\./)+', '') AS normal, regexp_extract(file, '^/srv/checkouts/(.*)$', 1) AS rel FROM store_meta")
def path_parts(spark, d):
    f = table(spark, d, "store_meta", ["file"]).distinct()
    c = F.col("file")
    return f.select("file", T.file_name(c).alias("name"), T.stem(c).alias("stem"), T.normal_path(c).alias("normal"), F.regexp_extract(c, "^/srv/checkouts/(.*)$", 1).alias("rel"))


@R.add("repo_by_prefix", "SELECT file, max(r.repo) AS repo FROM (SELECT DISTINCT file FROM store_meta) JOIN (SELECT DISTINCT lower(repo) AS repo FROM store_meta WHERE repo IS NOT NULL) r ON starts_with(file, '/srv/checkouts/' || r.repo || '/') GROUP BY file")
def repo_by_prefix(spark, d):
    """Files under known roots: the prefix is cut out and joined by equality."""
    m = table(spark, d, "store_meta", ["file", "repo"])
    roots = m.where("repo is not null").select(F.lower("repo").alias("repo")).distinct()
    return m.select("file").distinct().withColumn("repo", F.regexp_extract("file", "^/srv/checkouts/([^/]+)/", 1)).join(roots, "repo", "left_semi").select("file", "repo")


@R.add("line_statistics", f"SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x)))::INT AS longest FROM {DOCS} WHERE text IS NOT NULL")
def line_statistics(spark, d):
    x = docs(spark, d).where("text is not null").withColumn("l", T.lines(F.col("text")))
    return x.select("doc_id", F.size("l").alias("n_lines"), F.array_max(F.transform("l", F.length)).alias("longest"))


_WINDOWS = f"""(SELECT doc_id, i AS chunk, (i * 25 + 1)::INT AS start_line, least(n, i * 25 + 40)::INT AS end_line, trim(array_to_string(list_slice(l, i * 25 + 1, i * 25 + 40), chr(10)), ' ' || chr(10) || chr(9) || chr(13)) AS text
 FROM (SELECT doc_id, l, len(l) AS n, unnest(range(0, greatest(ceil((len(l) - 40) / 25.0), 0)::BIGINT + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {DOCS} WHERE text IS NOT NULL)))"""


def chunks(spark, d):
    return I.window_chunks(docs(spark, d).select(F.col("doc_id"), "text"))


@R.add("window_chunks", f"SELECT doc_id, chunk::INT AS chunk, start_line, end_line, md5(text) AS text_md5 FROM {_WINDOWS} WHERE length(text) >= 30")
def window_chunks(spark, d):
    return chunks(spark, d).select("doc_id", "chunk", "start_line", "end_line", F.md5("text").alias("text_md5"))


@R.add(
    "oversize_split",
    f"""WITH c AS (SELECT * FROM {_WINDOWS} WHERE length(text) >= 30), big AS (SELECT doc_id, start_line AS base, string_split(text, chr(10)) AS l FROM c WHERE length(text) > 2000),
p AS (SELECT doc_id, base, l, len(l) AS n, unnest(range(0, greatest(ceil((len(l) - 40) / 25.0), 0)::BIGINT + 1)) AS i FROM big),
s AS (SELECT doc_id, (i * 25 + base)::INT AS start_line, (least(n, i * 25 + 40) + base - 1)::INT AS end_line, trim(array_to_string(list_slice(l, i * 25 + 1, i * 25 + 40), chr(10)), ' ' || chr(10) || chr(9) || chr(13)) AS text FROM p)
SELECT doc_id, start_line, end_line, length(text)::INT AS chars FROM c WHERE length(text) <= 2000 UNION ALL SELECT doc_id, start_line, end_line, length(text)::INT FROM s WHERE length(text) >= 10""",
)
def oversize_split(spark, d):
    return I.split_large(chunks(spark, d), 2000).select("doc_id", "start_line", "end_line", F.length("text").alias("chars"))


_CODE = "list_filter(list_transform(string_split(doc, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|//|/\\*|\\*)'))"


@R.add(
    "chunk_classify",
    f"""WITH m AS (SELECT *, {_CODE} AS code FROM {META} WHERE doc IS NOT NULL), n AS (SELECT *, len(list_filter(code, lambda x: regexp_matches(x, {_sql(fixed.DECLARATION)}))) AS decl, len(list_filter(code, lambda x: NOT regexp_matches(x, {_sql(fixed.DECLARATION)}) AND regexp_matches(x, {_sql(fixed.STATEMENT)}))) AS stmt FROM m)
SELECT chunk_id, CASE WHEN hash < '1' THEN 'change' WHEN regexp_matches(file, {_sql(fixed.TEST_PATH)}) OR (symbol IS NOT NULL AND symbol <> '' AND regexp_matches(regexp_extract(symbol, '([^.]*)$', 1), {_sql(fixed.TEST_NAME)})) THEN 'test'
 WHEN start_line <= 5 AND (symbol IS NULL OR symbol = '') THEN 'module' WHEN decl >= 2 AND stmt <= greatest(1, decl // 3) THEN 'interface' WHEN symbol IS NOT NULL AND symbol <> '' THEN 'behavior' ELSE 'symbol' END AS class FROM n""",
)
def chunk_classify(spark, d):
    """Classes of stored chunks; files whose hash begins with 0 stand for recently changed ones."""
    m = meta(spark, d, "doc", "file", "start_line", "symbol", "hash").where("doc is not null")
    return m.select("chunk_id", I.chunk_class(F.col("file"), F.col("doc"), F.col("start_line"), F.col("symbol"), F.col("hash") < "1").alias("class"))


@R.add(
    "contextual_prefix",
    f"""SELECT chunk_id, rtrim(substr('This chunk is from ' || regexp_extract(file, '^/srv/checkouts/(.*)$', 1) || ' in the ' || coalesce(lower(repo), 'unknown') || ' repo, a ' || {lang_sql('file')} || ' file, covering ' || coalesce(nullif(symbol, ''), 'a line-window chunk') || ' at lines ' || start_line || '-' || end_line || '.', 1, 300)) AS prefix FROM {META}""",
)
def contextual_prefix(spark, d):
    m = meta(spark, d, "file", "repo", "symbol", "start_line", "end_line")
    c = I.context_prefix(F.regexp_extract("file", "^/srv/checkouts/(.*)$", 1), F.coalesce(F.lower("repo"), F.lit("unknown")), T.language_of(F.col("file")), F.col("symbol"), F.col("start_line"), F.col("end_line"))
    return m.select("chunk_id", c.alias("prefix"))


_NUMBERED = f"(SELECT chunk_id, file, start_line + i - 1 AS line, {lang_sql('file')} AS lang0, l[i] AS line_text FROM (SELECT chunk_id, file, start_line, string_split(doc, chr(10)) AS l, unnest(range(1, len(string_split(doc, chr(10))) + 1)) AS i FROM {META} WHERE doc IS NOT NULL))"
_LINES = f"(SELECT DISTINCT file, line, CASE WHEN lang0 = 'javascript' THEN 'typescript' ELSE lang0 END AS lang, lang0 AS language, line_text FROM {_NUMBERED})"


def numbered(spark, d):
    """Distinct numbered lines of all files in store_meta; overlapping windows count once."""
    m = meta(spark, d, "file", "doc", "start_line").where("doc is not null")
    x = m.select("file", "start_line", F.posexplode(T.lines(F.col("doc"))).alias("i", "line_text"))
    return x.select("file", (F.col("start_line") + F.col("i")).alias("line"), T.language_of(F.col("file")).alias("language"), "line_text").distinct()


# What the SQL expects is written out here, apart from the operators' own lists: languages, kind and pattern.
_JS = "'typescript', 'javascript', 'tsx', 'jsx'"
_W, _V = "([A-Za-z_][A-Za-z0-9_]*)", "([A-Za-z_$][A-Za-z0-9_$]*)"
_PUB, _MOD = r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?", r"^\s*(?:public|private|protected)?\s*"
_DEFINED = [
    ("'python'", "function", rf"^\s*(?:async\s+)?def\s+{_W}\s*\("), ("'python'", "class", rf"^\s*class\s+{_W}\b"),
    (_JS, "function", rf"^\s*(?:export\s+)?(?:async\s+)?function\s+{_V}"), (_JS, "class", rf"^\s*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+{_V}"),
    (_JS, "interface", rf"^\s*(?:export\s+)?interface\s+{_V}"), (_JS, "type", rf"^\s*(?:export\s+)?type\s+{_V}"), (_JS, "enum", rf"^\s*(?:export\s+)?enum\s+{_V}"),
    (_JS, "const", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_V}\s*=\s*(?:async\s*)?(?:\(|function)"),
    ("'go'", "function", rf"^\s*func\s+(?:\([^)]*\)\s*)?{_W}"), ("'go'", "type", rf"^\s*type\s+{_W}\s+(?:struct|interface)"),
    ("'rust'", "function", rf"{_PUB}(?:async\s+)?fn\s+{_W}"), ("'rust'", "struct", rf"{_PUB}struct\s+{_W}"), ("'rust'", "enum", rf"{_PUB}enum\s+{_W}"), ("'rust'", "trait", rf"{_PUB}trait\s+{_W}"),
    ("'java', 'csharp', 'kotlin'", "class", rf"{_MOD}(?:abstract\s+)?class\s+{_W}"), ("'java', 'csharp', 'kotlin'", "interface", rf"{_MOD}interface\s+{_W}"),
    ("'c', 'cpp'", "function", rf"^\s*(?:[\w:<>*&]+\s+)+{_W}\s*\([^)]*\)\s*\{{"), ("'c', 'cpp'", "class", rf"^\s*(?:class|struct)\s+{_W}"),
]
_IMPORTED = [
    ("'python'", r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.,\s]+))", True), (_JS, r"^\s*(?:import|export)\s+(?:.*?from\s+)?[\"']([^\"']+)[\"']", False), ("'go'", r"^\s*import\s+\"([^\"]+)\"", False),
    ("'rust'", r"^\s*use\s+([\w:]+)", False), ("'java'", r"^\s*import\s+([\w.]+);", False), ("'csharp'", r"^\s*using\s+([\w.]+);", False), ("'kotlin'", r"^\s*import\s+([\w.]+)", False), ("'c', 'cpp'", r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]", False),
]
_INHERITED = [
    ("'python'", rf"^\s*class\s+{_W}\s*\(([^)]+)\)"), ("'typescript', 'javascript', 'tsx'", rf"^\s*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+{_V}\s+extends\s+{_V}"), ("'java'", rf"{_MOD}(?:abstract\s+)?class\s+{_W}\s+extends\s+{_W}"),
]


@R.add("definitions_extract", " UNION ALL ".join(f"SELECT file, language, line::INT AS line, regexp_extract(line_text, {_sql(p)}, 1) AS symbol, '{k}' AS kind FROM {_LINES} WHERE language IN ({la}) AND regexp_extract(line_text, {_sql(p)}, 1) <> ''" for la, k, p in _DEFINED))
def definitions_extract(spark, d):
    return I.definitions(numbered(spark, d))


@R.add(
    "imports_extract",
    "SELECT file, language, line, target FROM (SELECT file, language, line, regexp_replace(trim(unnest(string_split(r, ','))), '\\s+as\\s+.*$', '') AS target FROM ("
    + " UNION ALL ".join(f"SELECT file, language, line::INT AS line, regexp_extract(line_text, {_sql(p)}, 1)" + (f" || regexp_extract(line_text, {_sql(p)}, 2)" if two else "") + f" AS r FROM {_LINES} WHERE language IN ({la})" for la, p, two in _IMPORTED)
    + ") WHERE r <> '') WHERE target <> '' UNION ALL SELECT file, language, line::INT, unnest(regexp_extract_all(line_text, '\"([^\"]+)\"', 1)) FROM ("
    + f"SELECT *, max(CASE WHEN regexp_matches(line_text, '\\bimport\\s+\\(') THEN line END) OVER (PARTITION BY file ORDER BY line, line_text ROWS UNBOUNDED PRECEDING) AS o, max(CASE WHEN contains(line_text, ')') THEN line END) OVER (PARTITION BY file ORDER BY line, line_text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM {_LINES} WHERE language = 'go') WHERE o IS NOT NULL AND (c IS NULL OR c < o)",
)
def imports_extract(spark, d):
    return I.imports(numbered(spark, d))


@R.add(
    "inheritance_extract",
    "SELECT file, language, line, child, unnest(list_distinct(regexp_extract_all(p, '([A-Za-z_][A-Za-z0-9_]*)', 1))) AS parent FROM ("
    + " UNION ALL ".join(f"SELECT file, language, line::INT AS line, regexp_extract(line_text, {_sql(p)}, 1) AS child, regexp_extract(line_text, {_sql(p)}, 2) AS p FROM {_LINES} WHERE language IN ({la})" for la, p in _INHERITED)
    + ") WHERE child <> ''",
)
def inheritance_extract(spark, d):
    return I.inheritance(numbered(spark, d))


@R.add("grep_lines", f"SELECT file, line::INT AS line, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '…' ELSE t END AS snippet FROM (SELECT file, line, line_text, trim(line_text) AS t FROM {_LINES}) WHERE contains(file, '/src/') AND regexp_matches(line_text, '(?i)limit\\s*[>=]+\\s*[0-9]+') ORDER BY file, line LIMIT 1000")
def grep_lines(spark, d):
    return I.grep(numbered(spark, d), r"limit\s*[>=]+\s*[0-9]+", "/src/").orderBy("file", "line").limit(1000)


@R.add(
    "read_slices",
    f"""WITH r AS (SELECT doc_id, (doc_id % 7 + 1)::INT AS s, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 7 + 12 END AS e FROM {DOCS}), j AS (SELECT r.*, string_split(text, chr(10)) AS l FROM r JOIN {DOCS} d USING (doc_id) WHERE text IS NOT NULL),
k AS (SELECT *, least(greatest((CASE WHEN e <= 0 THEN len(l) ELSE least(e, len(l)) END) - s + 1, 0), 400) AS n FROM j)
SELECT 'doc_' || doc_id AS file, s AS start_line, n::INT AS n_lines, CASE WHEN n = 0 THEN '' ELSE array_to_string(list_slice(l, s, s + n - 1), chr(10)) END AS body FROM k""",
)
def read_slices(spark, d):
    x = docs(spark, d).where("text is not null").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file"), "doc_id", "text")
    r = x.select("file", (F.col("doc_id") % 7 + 1).cast("int").alias("start_line"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 7 + 12).cast("int").alias("end_line"))
    return I.merge_slices(r, x)


@R.add("recent_changes", "SELECT file, max(indexed_at) AS changed_at FROM store_meta GROUP BY file ORDER BY changed_at DESC, file LIMIT 80")
def recent_changes(spark, d):
    return table(spark, d, "store_meta", ["file", "indexed_at"]).groupBy("file").agg(F.max("indexed_at").alias("changed_at")).orderBy(F.desc("changed_at"), "file").limit(80)


@R.add("rows_by_file", "SELECT file, count(DISTINCT chunk_id)::BIGINT AS chunks FROM store_meta GROUP BY file")
def rows_by_file(spark, d):
    return table(spark, d, "store_meta", ["file", "chunk_id"]).groupBy("file").agg(F.countDistinct("chunk_id").alias("chunks"))


_OLD = f"(SELECT doc_id AS file, md5(coalesce(text, '')) AS h FROM {DOCS} WHERE doc_id % 10 <> 0)"
_NEW = f"(SELECT doc_id AS file, md5(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS h FROM {DOCS} WHERE doc_id % 10 <> 1)"


@R.add("hash_diff_status", f"SELECT coalesce(o.file, n.file) AS file, CASE WHEN o.file IS NULL THEN 'new' WHEN n.file IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS status FROM {_OLD} o FULL JOIN {_NEW} n ON o.file = n.file")
def hash_diff_status(spark, d):
    """Two versions of the collection, made of it by the id: some files left out on either side, some altered."""
    x = docs(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    old = x.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("file"), F.md5("text").alias("hash"))
    new = x.where("doc_id % 10 <> 1").select(F.col("doc_id").alias("file"), F.md5(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "!").otherwise(""))).alias("hash"))
    return I.change_status(old, new)


@R.add("removed_files", f"SELECT o.file FROM {_OLD} o WHERE o.file NOT IN (SELECT file FROM {_NEW})")
def removed_files(spark, d):
    x = docs(spark, d).select(F.col("doc_id").alias("file"))
    return x.where("file % 10 <> 0").join(x.where("file % 10 <> 1"), "file", "left_anti")


@R.add(
    "upsert_chunks",
    "WITH s AS (SELECT DISTINCT chunk_id, file, hash FROM store_meta), f AS (SELECT CASE WHEN hash < '4' THEN chunk_id ELSE chunk_id || '#new' END AS chunk_id, file, md5(hash) AS hash FROM s WHERE hash < '8') SELECT * FROM s WHERE chunk_id NOT IN (SELECT chunk_id FROM f) UNION ALL SELECT * FROM f",
)
def upsert_chunks(spark, d):
    s = table(spark, d, "store_meta", ["chunk_id", "file", "hash"]).distinct()
    f = s.where("hash < '8'").select(F.when(F.col("hash") < "4", F.col("chunk_id")).otherwise(F.concat("chunk_id", F.lit("#new"))).alias("chunk_id"), "file", F.md5("hash").alias("hash"))
    return I.upsert(s, f, ["chunk_id"])


@R.add("delete_by_file", "SELECT file, count(DISTINCT chunk_id)::BIGINT AS chunks FROM store_meta WHERE file NOT IN (SELECT file FROM store_meta WHERE hash < '8') GROUP BY file")
def delete_by_file(spark, d):
    m = table(spark, d, "store_meta", ["file", "chunk_id", "hash"])
    return m.join(m.where("hash < '8'").select("file").distinct(), "file", "left_anti").groupBy("file").agg(F.countDistinct("chunk_id").alias("chunks"))


@R.add("index_statistics", "SELECT coalesce(lower(repo), 'unknown') AS repo, count(DISTINCT chunk_id)::BIGINT AS chunks, count(DISTINCT file)::BIGINT AS files, count(DISTINCT chunk_id) FILTER (symbol IS NOT NULL)::BIGINT AS with_symbol FROM store_meta GROUP BY 1")
def index_statistics(spark, d):
    m = table(spark, d, "store_meta", ["repo", "chunk_id", "file", "symbol"])
    return m.groupBy(F.coalesce(F.lower("repo"), F.lit("unknown")).alias("repo")).agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("file").alias("files"), F.countDistinct(F.when(F.col("symbol").isNotNull(), F.col("chunk_id"))).alias("with_symbol"))


_COMPONENTS = "embedder=default|reranker=default|chunker=2|retriever=3|prompt=2|graph=2"


_FP = "('0x' || substr(md5(file || ':' || hash), 1, 15))::BIGINT"


@R.add(
    "snapshot_fingerprint",
    f"SELECT repo, substr(sha1(count(*)::VARCHAR || ':' || sum({_FP})::VARCHAR || ':' || bit_xor({_FP})::VARCHAR), 1, 16) AS fingerprint, '{_COMPONENTS}' AS components FROM (SELECT DISTINCT coalesce(lower(repo), 'unknown') AS repo, file, hash FROM store_meta) GROUP BY repo",
)
def snapshot_fingerprint(spark, d):
    """One fingerprint per repository: number, sum and xor of its files' hashes, so a repository of any size is hashed with partial aggregates."""
    m = table(spark, d, "store_meta", ["repo", "file", "hash"]).select(F.coalesce(F.lower("repo"), F.lit("unknown")).alias("repo"), "file", "hash").distinct()
    h = F.conv(F.substring(F.md5(F.concat("file", F.lit(":"), "hash")), 1, 15), 16, 10).cast("bigint")
    g = m.withColumn("h", h).groupBy("repo").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x"))
    return g.select("repo", F.substring(F.sha1(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string"))), 1, 16).alias("fingerprint"), F.lit(_COMPONENTS).alias("components"))


@R.add("python_ast_chunks")
def python_ast_chunks(spark, d):
    """Header, classes, functions and methods of Python files by their syntax; windows where it doesn't parse."""
    from ..operators.syntax_chunks import python_chunks

    return python_chunks(meta(spark, d, "file", "doc", "start_line", "end_line"))


@R.add("identifier_references")
def identifier_references(spark, d):
    """Names used in files (comments and strings left out) with their lines."""
    from ..operators.syntax_chunks import references

    return references(meta(spark, d, "file", "doc", "start_line", "end_line"))


@R.add(
    "fenced_blocks",
    rf"""WITH b AS (SELECT doc_id, regexp_extract_all(text, '(?s)```([a-zA-Z0-9_+\-]+)?[^\S\n]*\n(.*?)```', 1) AS l, regexp_extract_all(text, '(?s)```([a-zA-Z0-9_+\-]+)?[^\S\n]*\n(.*?)```', 2) AS t FROM {DOCS} WHERE text IS NOT NULL),
e AS (SELECT doc_id, i - 1 AS pos, lower(coalesce(l[i], '')) AS lang, trim(t[i], ' ' || chr(10) || chr(9) || chr(13)) AS body FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM b))
SELECT doc_id, pos::INT AS pos, coalesce(map_extract_value(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in fixed.FENCE_ALIASES.items())}}}, lang), lang) AS lang, length(body)::INT AS chars FROM e""",
)
def fenced_blocks(spark, d):
    x = docs(spark, d).where("text is not null").select("doc_id", F.posexplode(T.fenced_blocks(F.col("text"))).alias("pos", "b"))
    return x.select("doc_id", "pos", F.col("b.lang").alias("lang"), F.length("b.body").alias("chars"))


@R.add("evidence_paths", f"SELECT doc_id, list_slice(list_sort(list_distinct(list_transform(regexp_extract_all(text, {_sql(fixed.EVIDENCE_PATH)}), lambda x: replace(x, '\\', '/')))), 1, 30) AS paths FROM {DOCS} WHERE text IS NOT NULL")
def evidence_paths(spark, d):
    x = docs(spark, d).where("text is not null")
    found = F.transform(F.regexp_extract_all("text", F.lit(fixed.EVIDENCE_PATH), F.lit(0)), lambda p: F.translate(p, "\\", "/"))
    return x.select("doc_id", F.slice(F.array_sort(F.array_distinct(found)), 1, 30).alias("paths"))


@R.add("content_hashes", f"SELECT doc_id, md5(text) AS md5, substr(sha1(text), 1, 16) AS sha1_16, length(text)::INT AS chars, ceil(length(text) / 4)::BIGINT AS tokens FROM {DOCS} WHERE text IS NOT NULL")
def content_hashes(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.md5("text").alias("md5"), F.substring(F.sha1("text"), 1, 16).alias("sha1_16"), F.length("text").alias("chars"), T.estimated_tokens(F.col("text")).alias("tokens"))


@R.add("props_json_canonical", "SELECT event_id, '{\"event\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def props_json_canonical(spark, d):
    """Arguments written again with sorted keys, as a memo key."""
    e = table(spark, d, "events", ["event_id", "event_type", "props"]).withColumn("k", F.get_json_object("props", "$.k")).where("k is not null")
    pair = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    m = F.map_from_entries(F.array_sort(F.array(pair("k", F.col("k")), pair("event", F.concat(F.lit('"'), "event_type", F.lit('"'))))))
    pairs = F.transform(F.map_entries(m), lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["value"]))
    return e.select("event_id", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("canonical"))


@R.add("source_cube", f"SELECT lang, source, count(*)::BIGINT AS documents, sum(n_chars)::BIGINT AS chars FROM {DOCS} GROUP BY CUBE (lang, source)")
def source_cube(spark, d):
    return docs(spark, d).cube("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@R.add("source_rollup", f"SELECT lang, source, count(*)::BIGINT AS documents FROM {DOCS} GROUP BY ROLLUP (lang, source)")
def source_rollup(spark, d):
    return docs(spark, d).rollup("lang", "source").agg(F.count("*").alias("documents"))
