"""Whole files out of overlapping line windows.

``store_meta`` holds a file as windows of lines. Windows are gathered per file without repeats and laid
over each other by line number, so overlapping lines count once. Missing lines come out empty, which
keeps the numbering. Rows without a file or a doc are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_width
from ..sources.tables import table

#: Spellings of one language, by its usual name (fixed values).
LANGUAGE_SPELLINGS = {
    "python": ["python", "py", "python3"], "javascript": ["javascript", "js", "node", "ecmascript"], "typescript": ["typescript", "ts"],
    "go": ["go", "golang"], "java": ["java"], "rust": ["rust", "rs"], "c": ["c"], "json": ["json"], "yaml": ["yaml", "yml"], "toml": ["toml"],
    "markdown": ["markdown", "md"], "bash": ["bash", "sh", "shell"],
}
#: Language of an extension (fixed values).
EXTENSION_LANGUAGE = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".java": "java", ".rs": "rust", ".c": "c", ".json": "json",
    ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown", ".sh": "bash",
}


def assemble(parts: list[dict]) -> str:
    """The text of a file from its windows {start_line, end_line, doc}."""
    lines: list[str] = []
    for p in sorted(parts, key=lambda p: (p["start_line"], p["end_line"])):
        new, start = p["doc"].split("\n"), p["start_line"] - 1
        if start > len(lines):
            lines += [""] * (start - len(lines))
        have = len(lines) - start
        if have < len(new):
            lines += new[have:]
    return "\n".join(lines)


def windows(spark: SparkSession, root: str) -> DataFrame:
    """file, repo (lower case, by the path where null), language and its windows, one row per file."""
    m = table(spark, root, "store_meta", ["file", "repo", "language", "start_line", "end_line", "doc"]).where("file is not null and doc is not null and start_line is not null")
    # a fixed width: text-heavy files take long to work on, so adaptive execution must not merge them to a few tasks
    g = m.repartition(max(shuffle_width(spark), spark.sparkContext.defaultParallelism), "file").groupBy("file").agg(
        F.min(F.lower("repo")).alias("repo"), F.min(F.lower("language")).alias("language"), F.collect_set(F.struct("start_line", F.coalesce("end_line", "start_line").alias("end_line"), "doc")).alias("parts")
    )
    by_path = F.lower(F.regexp_extract("file", r"^/?(?:[^/]+/){2}([^/]+)/", 1))
    return g.withColumn("repo", F.coalesce("repo", F.nullif(by_path, F.lit(""))))


def per_file(files: DataFrame, fields: list[tuple[str, str]], visit: Callable[[str, str], list[tuple]]) -> DataFrame:
    """Runs ``visit(file, text)`` over whole files; it returns rows of ``fields``; file, repo, language come along."""
    schema = ", ".join(["file string", "repo string", "language string", *(f"{n} {t}" for n, t in fields)])
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("file", "repo", "language", *names)}
            f, r, lang, parts = (b.column(i) for i in range(4))
            for i in range(b.num_rows):
                file, repo, la = f[i].as_py(), r[i].as_py(), lang[i].as_py()
                for row in visit(file, assemble(parts[i].as_py())):
                    out["file"].append(file)
                    out["repo"].append(repo)
                    out["language"].append(la)
                    for n, v in zip(names, row):
                        out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return files.select("file", "repo", "language", "parts").mapInArrow(run, schema)


def language_group(language: str | None, file: str) -> str:
    """One name for spellings that mean the same; without a known one, the extension decides."""
    ext = "." + file.rsplit(".", 1)[-1].lower() if "." in file.rsplit("/", 1)[-1] else ""
    if ext in EXTENSION_LANGUAGE:
        return EXTENSION_LANGUAGE[ext]
    said = (language or "").strip().lower()
    return next((k for k, v in LANGUAGE_SPELLINGS.items() if said in v), said or "unknown")
