"""Generated, minified, vendored and data files among source files.

Two kinds of evidence are put together:

* per file, what header and layout say (:func:`signs`);
* over all files, Merkle hashes bottom-up over the directory trees (:func:`shared_subtrees`): content that
  unrelated repositories share is a copy of a third party's, wherever it is kept. A directory's hash is an
  order-free combination of its children's, so a directory of any size is hashed with partial
  aggregation and no group is ever collected.

Defined results: an empty file has no signs and is never shared content; repeated rows and windows count
once; a null repo is read from the path; files that differ in blank lines, trailing blanks or the leading
comment only share their hash.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .files import per_file

_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|;|<!--|\"\"\"|''')[\s*!/#-]*(.*?)\s*(?:\*/|-->)?\s*$")
#: What a tool writes at the top of its output; the phrase opens the comment or is an order to the reader.
_GENERATED = re.compile(
    r"^@generated\b|^<?auto-?(?:generated|written)\b|^code generated\b|^generated (?:by|from|with|using|automatically)\b|do not (?:edit|modify|change)\b.*$"
    r"|\b(?:was|is|has been) (?:auto-?|automatically |machine-?)(?:generated|produced|created|written)|\b(?:generated|produced|created|written|emitted) automatically\b"
    r"|\bchanges (?:are|will be|get) (?:lost|overwritten)\b|\bedit the (?:template|schema|source|generator)\b|^machine[- ](?:generated|made|written)\b",
    re.I,
)
_VENDORED = re.compile(
    r"\bverbatim copy of\b|\bimported from the \S+ project\b|\blocal changes: |\bupstream https?://|\bredistributed under\b|\(c\) the \S+ contributors\b|\bfix bugs upstream\b"
    r"|^vendored (?:from|copy)\b|^(?:copied|taken|forked) from \S+ (?:at|release|version|v?\d)|\blicensed under the terms of the \S+ (?:project|package)\b",
    re.I,
)
_VENDOR_DIRS = {"vendor", "vendors", "third_party", "thirdparty", "third-party", "3rdparty", "3rd_party", "node_modules", "bower_components", "external", "externals", "deps", "site-packages", "godeps", "pods"}
_OUTPUT_DIRS = {"generated", "gen", "autogen", "__generated__"}
_OUTPUT_NAME = re.compile(r"(?:_pb2?|_gen|\.g|\.pb|\.generated|_generated)(?:\.pb)?\.\w+$")
_SCRIPT = {"js", "ts", "mjs", "cjs", "css", "html"}
_CODE = {"py", "js", "ts", "go", "java", "rs", "c", "h", "cc", "cpp", "cs", "kt", "rb", "php"}
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_LONG_COMMENT = re.compile(r"/\*.*?\*/|(?m:(?<!:)(?://|#).*$)", re.S)
_NUMBER = re.compile(r"(?<![\w.])-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w])")
_PACKED_ROW = re.compile(r"^\s*[\"'][A-Za-z0-9+/=_-]{40,}[\"']\s*[,+.)\\]*\s*$")
_COUNTER = re.compile(r"(?<=[A-Za-z_])\d+\b")


#: What opens a block in a leading comment, and what closes it.
_BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_EDGES = re.compile(r"^[\s*!/#-]*(.*?)\s*(?:\*/|-->|\"\"\"|''')?\s*$")
_DOCSTRING = re.compile(r"^(?:[rRuU])?(?=\"\"\"|''')")


def _header(text: str) -> list[str]:
    """Lines of the comments and the docstring before the first code, without their marks."""
    out: list[str] = []
    until = None  # the mark that closes the block the line stands in
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end].strip()
        at = end + 1
        if until is None:
            if not line or line.startswith("#!"):
                continue
            line = _DOCSTRING.sub("", line)
            mark = next((x for x in _BLOCKS if line.startswith(x)), None)
            if mark is None:
                m = _COMMENT.match(line)
                if not m:
                    break
                out.append(m.group(1))
                continue
            line, until = line[len(mark) :], _BLOCKS[mark]
        said, closed, rest = line.partition(until)
        out.append(_EDGES.match(said).group(1))
        if closed:
            until = None
            rest = rest.strip()
            if rest and not _COMMENT.match(rest):
                break
    return out


def _counted(lines: list[str]) -> float:
    """Share of the lines that belong to a run of at least eight lines of one shape, counted up by a number in their names."""
    shapes: dict[str, set[int]] = {}
    hits: dict[str, int] = {}
    for line in lines:
        n = _COUNTER.search(line)
        if n:
            shape = re.sub(r"[A-Za-z_$]+\d*|\d+", "a", line.strip())
            shapes.setdefault(shape, set()).add(int(n.group()))
            hits[shape] = hits.get(shape, 0) + 1
    good = sum(hits[s] for s, v in shapes.items() if len(v) >= 8 and len(v) >= 0.6 * (max(v) - min(v) + 1))
    return good / len(lines) if lines else 0.0


def _repeated(lines: list[str]) -> float:
    """Share of the lines whose shape (names and numbers left out) is one of the five most frequent."""
    shapes: dict[str, int] = {}
    for line in lines:
        s = re.sub(r"[A-Za-z_$]\w*|\d+", "a", line.strip())
        shapes[s] = shapes.get(s, 0) + 1
    return sum(sorted(shapes.values(), reverse=True)[:5]) / len(lines) if lines else 0.0


def signs(file: str, text: str) -> str | None:
    """``generated``, ``minified``, ``vendored``, ``data`` or None, from one file's path and text."""
    parts = file.replace("\\", "/").lower().split("/")
    dirs, name = set(parts[:-1]), parts[-1]
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    if dirs & _VENDOR_DIRS:
        return "vendored"
    head = _header(text)
    if any(_VENDORED.search(h) for h in head):
        return "vendored"
    lines = [x for x in text.split("\n") if x.strip()]
    code = [x for x in lines if not _COMMENT.match(x)]
    if ext in _CODE or ext in {"json", "css", "html", "yaml", "toml"}:
        if any(_GENERATED.search(h) for h in head):
            return "generated"
        if ext in _CODE and len(code) >= 6:
            counted = _counted(code)
            if counted >= 0.7 or counted >= 0.45 and len(code) >= 24 and _repeated(code) >= 0.95 or (counted >= 0.4 or _repeated(code) >= 0.8) and (dirs & _OUTPUT_DIRS or _OUTPUT_NAME.search(name)):
                return "generated"
    if ext in _CODE or ext == "json":
        packed = sum(len(x) for x in lines if _PACKED_ROW.match(x))
        if sum(1 for x in lines if _PACKED_ROW.match(x)) >= 8 and packed >= 0.7 * len(text):
            return "data"
        bare = _STRING.sub("", text)
        numbers = _NUMBER.findall(bare)
        if len(numbers) >= 80 and sum(len(n) + 2 for n in numbers) >= 0.7 * len(text):
            return "data"
    if ext in _SCRIPT:
        if re.search(r"[.-]min\.(?:js|mjs|cjs|css)$", name):
            return "minified"
        bare = _LONG_COMMENT.sub("", _STRING.sub("''", text)).strip()
        rows = bare.count("\n") + 1
        if len(bare) >= 200 and len(bare) / rows >= 120 and sum(map(bare.count, " \t\n")) < 0.1 * len(bare):
            return "minified"
    return None


def content_key(text: str) -> tuple[str, int]:
    """MD5 of the lines without blank ones, trailing blanks and the leading comment; and how many lines these are."""
    lines = [x.rstrip() for x in text.replace("\r\n", "\n").split("\n")]
    lines = [x for x in lines if x]
    i = 0
    while i < len(lines) and _COMMENT.match(lines[i]):
        i += 1
    return hashlib.md5("\n".join(lines[i:]).encode("utf-8", "surrogatepass")).hexdigest(), len(lines) - i


def shared_subtrees(leaves: DataFrame, least_lines: int = 8) -> DataFrame:
    """(file, repo, content, n_lines) -> (file, repos): files inside a subtree that several repositories hold.

    Bottom-up: at each depth the children of a directory (files and finished directories) are combined to its
    hash: their number, the sum and the xor of their hashes. A subtree counts if it has ``least_lines`` lines;
    repositories with equal root hashes are one (forks), so they don't vouch for each other.
    """
    leaves = cut(leaves.select("file", F.coalesce("repo", F.lit("")).alias("repo"), "content", F.col("n_lines").cast("bigint").alias("n_lines"), F.size(F.split("file", "/")).alias("depth")))
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    nodes = leaves.select(F.col("file").alias("path"), "repo", F.xxhash64("content").alias("h"), "n_lines", "depth")
    done, level = [nodes], None
    for depth in range(deepest, 1, -1):
        here = nodes.where(F.col("depth") == depth)
        here = here if level is None else here.unionByName(level)
        up = here.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path"), "repo").agg(
            F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x"), F.sum("n_lines").alias("n_lines")
        )
        level = cut(up.select("path", "repo", F.xxhash64("n", "s", "x").alias("h"), "n_lines", F.lit(depth - 1).alias("depth")))
        done.append(level)
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    every = every.where("path <> ''")
    # the hash of a repository's own root: the shallowest directory that only it lives in
    tops = every.groupBy("repo").agg(F.min_by("h", F.struct(-F.col("n_lines"), "depth")).alias("fork"))
    shared = every.where(F.col("n_lines") >= least_lines).join(tops, "repo").groupBy("h").agg(F.min("fork").alias("lo"), F.max("fork").alias("hi"), F.approx_count_distinct("repo").alias("repos")).where("lo <> hi")
    marked = every.join(shared.select("h", "repos"), "h", "left_semi").select(F.col("path").alias("top"))
    above = leaves.select("file", F.posexplode(F.split("file", "/")).alias("i", "_")).select("file", F.array_join(F.slice(F.split("file", "/"), F.lit(1), F.col("i") + 1), "/").alias("top"))
    return above.where("top <> ''").join(marked.distinct(), "top", "left_semi").select("file").distinct()


def not_handwritten(files: DataFrame) -> DataFrame:
    """file, repo, reason of every file that wasn't written by hand in its repository."""

    def visit(file: str, text: str) -> list[tuple]:
        key, n = content_key(text)
        return [(signs(file, text), key, n)]

    seen = cut(per_file(files, [("sign", "string"), ("content", "string"), ("n_lines", "int")], visit))
    copies = shared_subtrees(seen).withColumn("copied", F.lit("vendored"))
    return seen.join(copies, "file", "left").select("file", "repo", F.coalesce("sign", "copied").alias("reason")).where("reason is not null")
