"""Filling fixed-capacity containers with whole texts: vector best-fit, planned on the histogram of sizes.

Sizes are whole numbers up to the capacity, so the histogram has at most capacity + 1 classes, however many texts
there are. Best-fit decreasing runs on it for whole classes at a time: bins with equal residuals (tokens, number
of texts, attention cost in tiles) are one class with ranges of bin numbers; among the classes that fit under every
constraint the one with the smallest weighted norm of residuals is filled. The plan (which ranks of a size go
to which bins) is bounded by the capacity as well; each text finds its bin by its rank among the texts of its size,
which is counted per partition, so no size is ever gathered in one task.

Defined results: repeated ids count once; null texts have no place; empty texts have size 0 and use up only a
text's place; a text larger than the container is cut into full pieces and a rest; null capacities or capacities
below 1 are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

MOST_TEXTS = 1024  #: texts in one container
WEIGHTS = (1.0, 0.05, 0.05)  #: of the residual tokens, texts and attention cost, each as a share of its capacity


def tile_of(capacity: int) -> int:
    """Tokens of a side of an attention tile: the power of two above the root of the capacity, 16 to 128."""
    return min(128, max(16, 1 << int(np.sqrt(capacity)).bit_length()))


def attention_cost(size: int, tile: int) -> int:
    """Attention is computed in tiles: a text costs the square of its size, rounded up to whole tiles."""
    return (-(-size // tile) * tile) ** 2


def plan_bins(histogram: dict[int, int], capacity: int, most_texts: int = MOST_TEXTS, most_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS, tile: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(size, first rank, last rank + 1, first bin, texts per bin) rows and the number of bins.

    ``most_cost`` defaults to what one text of the full capacity costs; since a text costs at least one tile, it
    is the bound that holds where many small texts come together.
    """
    tile = tile or tile_of(capacity)
    most_cost = most_cost or attention_cost(capacity, tile)
    if most_cost < attention_cost(capacity, tile):
        raise ValueError("a text that fills the container must be allowed its cost")
    full = np.array([capacity, most_texts, most_cost], dtype=np.float64)
    w = np.array(weights) / full
    classes: dict[tuple[int, int, int], list[list[int]]] = {}  # residuals -> ranges [first, last + 1) of bins
    table = np.zeros((0, 3), dtype=np.int64)
    stale, bins, rows = False, 0, []

    def put(key: tuple[int, int, int], span: list[int]) -> None:
        nonlocal stale
        if span[0] < span[1] and key[1] > 0:
            if key not in classes:
                classes[key] = []
                stale = True
            classes[key].append(span)

    def fits(key, size: int) -> int:
        by_tokens = key[0] // size if size else key[1]
        by_cost = key[2] // attention_cost(size, tile) if size else key[1]
        return int(min(by_tokens, key[1], by_cost))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            if stale:
                table = np.array(list(classes), dtype=np.int64).reshape(-1, 3)
                stale = False
            n = np.zeros(0, dtype=np.int64)
            if len(table):
                d = np.array([max(size, 1), 1, max(attention_cost(size, tile), 1)])
                q = table // d if size else np.stack([table[:, 1]] * 3, axis=1)
                n = q.min(axis=1)
            if len(n) and n.max() > 0:
                after = table - n[:, None] * np.array([size, 1, attention_cost(size, tile)])
                norm = ((after * w) ** 2).sum(axis=1)
                norm[n <= 0] = np.inf
                key = tuple(int(x) for x in table[int(norm.argmin())])
                per = fits(key, size)
                spans = classes[key]
                a, b = spans.pop()
                if not spans:
                    del classes[key]
                    stale = True
            else:
                key = (capacity, most_texts, most_cost)
                per = max(1, fits(key, size))
                a = bins
                b = bins = bins + -(-left // per)
            used = min(b - a, -(-left // per))
            placed = min(left, used * per)
            rows.append((size, rank, rank + placed, a, per))
            whole = placed // per
            put((key[0] - per * size, key[1] - per, key[2] - per * attention_cost(size, tile)), [a, a + whole])
            rest = placed - whole * per
            if rest:
                put((key[0] - rest * size, key[1] - rest, key[2] - rest * attention_cost(size, tile)), [a + whole, a + whole + 1])
            put(key, [a + used, b])
            left -= placed
            rank += placed
    return rows, bins


def token_sizes(documents: DataFrame, encoding_path: str | None = None) -> DataFrame:
    """(doc_id, tokens), one row per id, under a public byte-level BPE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokenizers import tiktoken_encoding

        e = tiktoken_encoding(encoding_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(e.encode_ordinary(t)) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "tokens"])

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, "doc_id bigint, tokens bigint").dropDuplicates(["doc_id"])


def pack(sizes: DataFrame, containers: DataFrame, most_texts: int = MOST_TEXTS) -> DataFrame:
    """sizes(doc_id, tokens) x containers(container, capacity_tokens) -> container, doc_id, piece, tokens, bin."""
    caps = {r[0]: int(r[1]) for r in containers.where("container is not null and capacity_tokens >= 1").groupBy("container").agg(F.max("capacity_tokens")).limit(MOST_CONTAINERS + 1).collect()}
    if len(caps) > MOST_CONTAINERS:
        raise ValueError("more kinds of containers than a plan is made for")
    spark = sizes.sparkSession
    schema = "container string, doc_id bigint, piece int, tokens bigint, bin bigint"
    if not caps:
        return spark.createDataFrame([], schema)
    kinds = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).alias("capacity")) for c, n in sorted(caps.items())])
    each = sizes.select("doc_id", "tokens", F.explode(kinds).alias("k")).select("doc_id", "tokens", "k.container", "k.capacity")
    parts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))).cast("int")
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), parts - 1))).select("container", "doc_id", "piece", F.least(F.col("capacity").cast("bigint"), F.col("tokens") - F.col("piece") * F.col("capacity")).alias("tokens"))
    pieces = cut(pieces).withColumn("pid", F.spark_partition_id())  # the written partitions make the ranks repeatable
    counts = cut(pieces.groupBy("container", "tokens", "pid").agg(F.count("*").alias("n")))
    w = Window.partitionBy("container", "tokens").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    plans: dict[str, tuple] = {}
    for c, cap in caps.items():
        histogram = {int(r[0]): int(r[1]) for r in counts.where(F.col("container") == c).groupBy("tokens").agg(F.sum("n")).collect()}  # at most capacity + 1 rows
        rows, _ = plan_bins(histogram, cap, most_texts)
        a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        plans[c] = tuple(a[:, i] for i in range(5))
    given = spark.sparkContext.broadcast(plans)  # bounded by the capacities

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, int] = {}
        for b in batches:
            g = b.groupby(["container", "tokens"], sort=False)
            start = [seen.get(k, 0) for k in zip(b["container"], b["tokens"])]
            b["local"] = g.cumcount() + start
            for k, n in g.size().items():
                seen[k] = seen.get(k, 0) + int(n)
            yield b

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros(len(b), dtype=np.int64)
            size, rank, kind = b["tokens"].to_numpy(), (b["local"] + b["before"]).to_numpy(), b["container"].to_numpy()
            for c, (s, lo, _, first, per) in given.value.items():
                own = np.nonzero(kind == c)[0]
                if not len(own):
                    continue
                key = s * (1 << 44) + lo
                at = np.searchsorted(key, size[own] * (1 << 44) + rank[own], "right") - 1
                out[own] = first[at] + (rank[own] - lo[at]) // per[at]
            yield pd.DataFrame({"container": b["container"], "doc_id": b["doc_id"], "piece": b["piece"], "tokens": b["tokens"], "bin": out})

    local = pieces.mapInPandas(number, "container string, doc_id bigint, piece int, tokens bigint, pid int, local bigint")
    return local.join(offsets, ["container", "tokens", "pid"]).select("container", "doc_id", "piece", "tokens", "local", "before").mapInPandas(place, schema)


#: Kinds of containers that one call plans for.
MOST_CONTAINERS = 100


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Bins, texts, tokens and the unused share of every kind of container."""
    t = packed.groupBy("container").agg(F.max("bin").alias("last"), F.countDistinct("doc_id").alias("documents"), F.sum("tokens").alias("tokens"))
    j = t.join(containers.groupBy("container").agg(F.max("capacity_tokens").alias("capacity")), "container")
    bins = F.col("last") + 1
    return j.select("container", bins.alias("bins"), "documents", "tokens", F.round(1 - F.col("tokens") / (bins * F.col("capacity")), 6).alias("unused"))
