"""Packing: optimal length buckets from the global histogram, and token-budget batches inside each bucket.

A text's length is its number of white-space tokens. The histogram of all lengths is
exact below ``EXACT`` and has ``STEPS`` cells an octave above, so it has at most
``EXACT + STEPS * log2(longest)`` rows whatever the corpus; each cell keeps its number
of texts, their tokens and its longest length. Dynamic programming over the cells
finds the ``buckets`` boundaries (longest lengths of cells) that pad least, when every
text is padded to its bucket's boundary: it is optimal among all choices of those
boundaries, hence among all choices where every length has its own cell.

A batch of a bucket holds ``max(1, budget // boundary)`` texts, so its padded tokens stay within the budget
(a text longer than the budget is a batch of its own). Texts are numbered through the bucket in the order of doc_id: they are
sorted by ranges, counted by range, and each range starts where the ones before it end. Only counts by range and bucket reach the driver.

Defined cases: null and empty texts have length 0 and go to the first bucket; fewer distinct lengths than buckets give
as many buckets as lengths; null doc_ids come first; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm import jobs

BUCKETS = 12
BUDGET = 65_536
EXACT = 1024
STEPS = 128


def n_tokens(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cell(length: Column) -> Column:
    """The histogram cell of a length: the length itself below EXACT, else its octave's step."""
    step = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double")))) / STEPS).cast("long")
    return F.when(length < EXACT, length).otherwise((length / step).cast("long") * step)


def best_boundaries(longest: list[int], count: list[int], total: list[int], buckets: int = BUCKETS) -> list[int]:
    """Boundaries of at most ``buckets`` buckets with the least padding, for cells in rising order."""
    m = len(longest)
    if not m:
        return []
    top = np.array(longest, dtype=np.int64)
    c, s = (np.concatenate(([0], np.cumsum(np.array(x, dtype=np.int64)))) for x in (count, total))
    best = np.where(np.arange(m + 1) > 0, np.iinfo(np.int64).max // 4, 0)
    choice = []
    for _ in range(min(buckets, m)):
        new, came = best.copy(), np.full(m + 1, -1)
        for j in range(1, m + 1):
            cost = best[:j] + top[j - 1] * (c[j] - c[:j]) - (s[j] - s[:j])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], came[j] = cost[i], i
        best = new
        choice.append(came)
    out, j = [], m
    for came in reversed(choice):
        if j and came[j] >= 0:
            out.append(int(top[j - 1]))
            j = int(came[j])
    return out[::-1]


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy(cell(F.col("n_tokens")).alias("cell")).agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, bucket, boundary, batch, slot) of every row: its bucket, its batch there, and its place in the batch."""
    lengths = jobs.cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), n_tokens(F.col(text_col)).alias("n_tokens")))
    cells = sorted((r.longest, r.texts, r.tokens) for r in histogram(lengths).collect())
    tops = best_boundaries(*([x[i] for x in cells] for i in range(3)), buckets=buckets) or [0]
    bucket, boundary = F.lit(len(tops) - 1), F.lit(tops[-1])
    for i in range(len(tops) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= tops[i], i).otherwise(bucket)
        boundary = F.when(F.col("n_tokens") <= tops[i], tops[i]).otherwise(boundary)
    ranges = jobs.cut(
        lengths.repartitionByRange(jobs.partitions(docs.sparkSession), "doc_id", "n_tokens")
        .select("doc_id", "n_tokens", bucket.alias("bucket"), boundary.cast("long").alias("boundary"), F.spark_partition_id().alias("part"))
    )
    # counts by range and bucket: as many rows as partitions times buckets
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("part", "bucket").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("part", "bucket").orderBy("doc_id", "n_tokens")
    numbered = ranges.withColumn("i", F.row_number().over(inside) - 1).join(starts, ["part", "bucket"])
    place = F.col("start") + F.col("i")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1)))).cast("long")
    return numbered.select("doc_id", "n_tokens", "bucket", "boundary", F.floor(place / room).cast("long").alias("batch"), (place % room).cast("long").alias("slot"))
