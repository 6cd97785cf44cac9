"""From files to chunks: noise filter, line windows, classes, prefixes, definitions, imports, change status.

Nulls: a file without text has no chunks and reason ``unreadable``; an empty text has reason ``empty`` and no chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def noise_reason(file: Column, size: Column) -> Column:
    """Why a file isn't indexed, or null."""
    name = T.file_name(file)
    ends = reduce(lambda a, b: a | b, [F.lower(name).endswith(x) for x in fixed.IGNORED_ENDINGS])
    return (
        F.when(name.isin(*fixed.IGNORED_NAMES), "ignored name")
        .when(ends, "ignored suffix")
        .when(size.isNull(), "unreadable")
        .when(size > fixed.MAX_FILE_BYTES, "too large")
        .when(size == 0, "empty")
    )


def indexable(file: Column) -> Column:
    """Known suffix and no ignored directory on the path."""
    dirs = F.slice(F.split(F.translate(file, "\\", "/"), "/"), 1, F.greatest(F.size(F.split(file, "[/\\\\]")) - 1, F.lit(0)))
    return T.suffix(file).isin(*fixed.INDEXED_SUFFIXES) & ~F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in fixed.IGNORED_DIRS]))


def window_chunks(files: DataFrame, size: int = fixed.CHUNK_LINES, overlap: int = fixed.CHUNK_OVERLAP, least: int = fixed.MIN_CHUNK_LEN) -> DataFrame:
    """files(file, text, ...) -> one row per line window: chunk, start_line, end_line, text; ends at the first window that reaches the end."""
    step = size - overlap
    f = files.drop("chunk").where("text is not null").withColumn("_l", T.lines(F.col("text")))
    n = F.size("_l")
    count = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    g = f.withColumn("_i", F.explode(F.sequence(F.lit(0), count))).withColumn("start_line", F.col("_i") * step + 1).withColumn("end_line", F.least(n, F.col("_i") * step + size))
    body = F.trim(F.array_join(F.slice("_l", F.col("start_line"), size), "\n"), F.lit(" \n\t\r"))
    return g.withColumn("text", body).where(F.length("text") >= least).withColumnRenamed("_i", "chunk").drop("_l")


def split_large(chunks: DataFrame, most: int = fixed.MAX_CHUNK_CHARS) -> DataFrame:
    """Chunks over ``most`` characters come as line windows of their own, counted on from their start line."""
    small = chunks.where(F.length("text") <= most)
    big = chunks.where(F.length("text") > most).withColumn("_base", F.col("start_line")).drop("start_line", "end_line", "chunk")
    parts = window_chunks(big, least=10).withColumn("start_line", F.col("start_line") + F.col("_base") - 1).withColumn("end_line", F.col("end_line") + F.col("_base") - 1)
    return small.unionByName(parts.select(*small.columns))


def interface_like(text: Column) -> Column:
    """Mostly declarations and few statements."""
    code = F.filter(F.transform(T.lines(text), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^(#|//|/\*|\*)"))
    declared = F.size(F.filter(code, lambda x: x.rlike(fixed.DECLARATION)))
    stated = F.size(F.filter(code, lambda x: ~x.rlike(fixed.DECLARATION) & x.rlike(fixed.STATEMENT)))
    return (declared >= 2) & (stated <= F.greatest(F.lit(1), F.floor(declared / 3)))


def chunk_class(file: Column, text: Column, start_line: Column, symbol: Column, changed: Column) -> Column:
    """change > test > module > interface > behavior > symbol."""
    no_symbol = symbol.isNull() | (symbol == "")
    tested = F.translate(file, "\\", "/").rlike(fixed.TEST_PATH) | (~no_symbol & F.regexp_extract(symbol, r"([^.]*)$", 1).rlike(fixed.TEST_NAME))
    return F.when(changed, "change").when(F.coalesce(tested, F.lit(False)), "test").when((start_line <= 5) & no_symbol, "module").when(interface_like(text), "interface").when(~no_symbol, "behavior").otherwise("symbol")


def context_prefix(rel: Column, repo: Column, language: Column, symbol: Column, start: Column, end: Column, most: int = 300) -> Column:
    said = F.concat(
        F.lit("This chunk is from "), rel, F.lit(" in the "), repo, F.lit(" repo, a "), language, F.lit(" file, covering "),
        F.coalesce(F.nullif(symbol, F.lit("")), F.lit("a line-window chunk")), F.lit(" at lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("."),
    )
    return F.rtrim(F.substring(said, 1, most))


def file_lines(files: DataFrame) -> DataFrame:
    """files(file, language, text, ...) -> one row per line with its number."""
    return files.select("file", "language", F.posexplode(T.lines(F.col("text"))).alias("_i", "line_text")).select("file", "language", (F.col("_i") + 1).alias("line"), "line_text")


def _family(families: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(F.col("language") == k, v) for k, v in families.items()], F.col("language"))


def definitions(numbered: DataFrame) -> DataFrame:
    """(file, language, line, line_text) -> symbol, kind per declaring line; related languages are read alike."""
    x = numbered.withColumn("_f", _family(fixed.DEFINITION_FAMILY))
    hits = [F.when((F.col("_f") == la) & (F.regexp_extract("line_text", p, 1) != ""), F.struct(F.regexp_extract("line_text", p, 1).alias("symbol"), F.lit(k).alias("kind"))) for la, k, p in fixed.DEFINITIONS]
    return x.withColumn("_h", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull()))).select("file", "language", "line", "_h.symbol", "_h.kind")


def _grouped_imports(numbered: DataFrame) -> DataFrame:
    """The modules of Go's import lists: lines between ``import (`` and the parenthesis that closes it."""
    g = numbered.where("language = 'go'").withColumn("_open", F.col("line_text").rlike(fixed.GROUP_OPENS))
    w = Window.partitionBy("file").orderBy("line", "line_text").rowsBetween(Window.unboundedPreceding, 0)  # the lines of one file
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.max(F.when(F.col("_open"), F.col("line"))).over(w)
    closed = F.max(F.when(F.col("line_text").rlike(fixed.GROUP_CLOSES), F.col("line"))).over(before)
    inside = g.withColumn("_o", opened).withColumn("_c", closed).where("_o is not null and (_c is null or _c < _o)")
    return inside.select("file", "language", "line", F.explode(F.regexp_extract_all("line_text", F.lit(fixed.GROUP_MEMBER), F.lit(1))).alias("target"))


def imports(numbered: DataFrame) -> DataFrame:
    """One row per imported module; lists of modules are taken apart, aliases dropped."""
    x = numbered.withColumn("_f", _family(fixed.IMPORT_FAMILY))
    raw = F.coalesce(*[F.when(F.col("_f") == la, F.concat(F.regexp_extract("line_text", p, 1), F.regexp_extract("line_text", p, 2))) for la, p in fixed.IMPORTS])
    one = x.withColumn("_r", raw).where("_r <> ''").withColumn("target", F.explode(F.split("_r", ",")))
    one = one.withColumn("target", F.regexp_replace(F.trim("target"), r"\s+as\s+.*$", "")).where("target <> ''").select("file", "language", "line", "target")
    return one.unionByName(_grouped_imports(numbered))


def inheritance(numbered: DataFrame) -> DataFrame:
    """(file, line, child, parent): every identifier of the list of parents."""
    x = numbered.withColumn("_f", _family(fixed.INHERIT_FAMILY))
    child = F.coalesce(*[F.when(F.col("_f") == la, F.regexp_extract("line_text", p, 1)) for la, p in fixed.INHERITS])
    parents = F.coalesce(*[F.when(F.col("_f") == la, F.regexp_extract("line_text", p, 2)) for la, p in fixed.INHERITS])
    g = x.withColumn("child", child).withColumn("_p", parents).where("child <> ''")
    return g.withColumn("parent", F.explode(F.array_distinct(F.regexp_extract_all("_p", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))))).select("file", "language", "line", "child", "parent")


def change_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, hash) twice -> file, status: new, removed, updated or unchanged."""
    j = old.select("file", F.col("hash").alias("h0"), F.lit(1).alias("in0")).join(new.select("file", F.col("hash").alias("h1"), F.lit(1).alias("in1")), "file", "full")
    return j.select("file", F.when(F.col("in0").isNull(), "new").when(F.col("in1").isNull(), "removed").when(F.col("h0").eqNullSafe(F.col("h1")), "unchanged").otherwise("updated").alias("status"))


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows without those whose key comes again, and the fresh rows."""
    # columns that only one side has are null on the other
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def merge_slices(requests: DataFrame, files: DataFrame, most_lines: int = 400) -> DataFrame:
    """requests(file, start_line, end_line) x files(file, text): the lines asked for, 1-based, end 0 = to the end."""
    j = requests.join(files.select("file", "text"), "file", "left").withColumn("_l", T.lines(F.col("text")))
    end = F.when(F.col("end_line") <= 0, F.size("_l")).otherwise(F.least("end_line", F.size("_l")))
    n = F.least(F.greatest(end - F.col("start_line") + 1, F.lit(0)), F.lit(most_lines))
    return j.select("file", "start_line", n.alias("n_lines"), F.array_join(F.slice("_l", F.greatest("start_line", F.lit(1)), n), "\n").alias("body"))


def grep(numbered: DataFrame, pattern: str, path_part: str = "", most_chars: int = 200) -> DataFrame:
    """Lines that match a pattern, whatever the case; trimmed and cut."""
    t = F.trim(F.col("line_text"))
    cut = F.when(F.length(t) > most_chars, F.concat(F.substring(t, 1, most_chars), F.lit("…"))).otherwise(t)
    return numbered.where(F.col("file").contains(path_part) & F.col("line_text").rlike(f"(?i){pattern}")).select("file", "line", cut.alias("snippet"))
