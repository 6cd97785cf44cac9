"""Column functions on text: tokens, lines, paths, identifiers, fences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def search_tokens(c: Column) -> Column:
    """Identifier-aware lower-case tokens: words split at underscores and case changes, numbers as they are."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0)), lambda x: F.lower(x))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def file_name(c: Column) -> Column:
    return F.regexp_extract(F.translate(c, "\\", "/"), r"([^/]*)$", 1)


def suffix(c: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(c), r"\.([^.]*)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(file_name(c), r"\.[^.]*$", "")


def language_of(c: Column) -> Column:
    """The language of a path's suffix, else the suffix itself."""
    table = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGE_BY_SUFFIX.items() for x in kv])
    s = suffix(c)
    return F.coalesce(F.element_at(table, s), s)


def normal_path(c: Column) -> Column:
    """Slashes forward, lower case, without leading ``./``."""
    return F.regexp_replace(F.lower(F.translate(c, "\\", "/")), r"^(?:\./)+", "")


def any_phrase(c: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in phrases])


def in_words(c: Column, words: list[str]) -> Column:
    return c.isin(*words)


def looks_like_symbol(t: Column) -> Column:
    """snake_case, UPPER_CONST or mixed case; at least three characters and no prose word."""
    shaped = F.regexp_replace(t, r"^_+|_+$", "").contains("_") | ((F.upper(t) == t) & t.rlike("[A-Z]")) | t.rlike(fixed.MIXED_CASE)
    return (F.length(t) >= 3) & ~in_words(F.lower(t), fixed.PROSE_WORDS) & shaped


def path_mentions(c: Column) -> Column:
    """Paths named in a text, sorted; well-known names without a suffix behind them."""
    found = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(fixed.PATH_MENTION), F.lit(0)), lambda x: ~x.startswith("."))))
    words = F.split(F.lower(c), r"[^a-z0-9_]+")
    known = F.filter(F.array(*[F.lit(x) for x in sorted(fixed.KNOWN_FILES)]), lambda x: F.array_contains(words, x) & ~F.array_contains(found, x))
    return F.concat(found, known)


def fenced_blocks(c: Column) -> Column:
    """[(lang, body)] of the fenced code in a text; aliases of languages brought together."""
    pattern = r"(?s)```([a-zA-Z0-9_+\-]+)?[^\S\n]*\n(.*?)```"
    langs = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    bodies = F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    table = F.create_map(*[F.lit(x) for kv in fixed.FENCE_ALIASES.items() for x in kv])
    return F.zip_with(langs, bodies, lambda lang, b: F.struct(F.coalesce(F.element_at(table, F.lower(lang)), F.lower(lang)).alias("lang"), F.trim(b, F.lit(" \n\t\r")).alias("body")))


def content_words(c: Column) -> Column:
    """Distinct lower-case words without fillers and surrounding brackets or quotes, in order."""
    raw = F.transform(F.split(F.trim(c), r"[\s,;:?!]+"), lambda x: F.lower(F.regexp_replace(x, r"^[()\[\]{}<>\"'`]+|[()\[\]{}<>\"'`]+$", "")))
    return F.array_distinct(F.filter(raw, lambda x: (x != "") & ~in_words(x, fixed.FILLER_WORDS)))


def estimated_tokens(c: Column) -> Column:
    """Default token count where no tokenizer is plugged in: a quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("bigint")


def sigmoid(c: Column) -> Column:
    x = F.when(F.isnan(c), F.lit(0.0)).when(c == float("inf"), F.lit(10.0)).when(c == float("-inf"), F.lit(-10.0)).otherwise(c)
    return 1 / (1 + F.exp(-x))


def logit(c: Column) -> Column:
    p = F.least(F.greatest(c, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.ln(p / (1 - p))


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """L2-normalised; a vector of length zero stays."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))
