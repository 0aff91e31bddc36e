"""Line dedup by a suffix array over line-id sequences, ranked by distributed prefix doubling.

A document is the sequence of its lines that are not blank. Suffixes are
ranked by their first 1, 2, ... lines: a round joins the ranks of a suffix and of the
ones that start where its ranked prefix ends, and sorts the distinct keys to give the new ranks. A rank is the place of the
suffix's bucket in the suffix array; suffixes with one rank after ``n`` lines are an
interval of the array whose longest common prefix is ``n`` or more. A bucket with one
suffix is in its final place and leaves the work, so the rounds shrink to what
is really repeated, and they end (after about log(longest run) rounds) when no bucket holds two.

In each interval with a common prefix of ``min_lines`` or more, the first suffix (smallest
doc_id, then place) stays; the run of lines that every later one starts with is deleted. The union of
these runs over all rounds is every maximal repeated run of later copies.

Hot lines: buckets are counted by keys with partial sums before any
shuffle; only distinct keys are sorted; and they are written before the join that hands ranks back, so that both of its sides are dealt anew and Spark
can split a line that very many texts have.

Defined cases: null and empty texts are left as they are; blank lines are
never deleted and do not part a run; a text's own repeats count; a text whose lines are all
deleted becomes empty; rows with a null doc_id are left as they are; repeated rows of one
doc_id and text are one document, and all get the same text; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm import jobs
from plinth.llm.kernels import LINES, Tokens, filled, signed, text_chunks

MIN_LINES = 2
_KEY = ["doc_id", "copy"]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "copy", "pos", "rank"]
    for batch in batches:
        for a, b, data, offs in text_chunks(batch.column(2)):
            t = Tokens(data, offs, LINES, lower=False)
            h, keep = t.hashes(), filled(t)
            doc = t.doc[keep]
            first = np.searchsorted(doc, np.arange(b - a))
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(at), batch.column(1).slice(a, b - a).take(at), pa.array((np.arange(len(doc)) - first[doc]).astype(np.int32)), pa.array(signed(h[keep]))], names=names)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``n`` over the rows before, within this partition."""
    before, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        n = batch.column(batch.num_columns - 1).to_numpy()
        start = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start), pa.array(np.full(len(n), part, np.int32))], names=[*batch.schema.names, "start", "part"])


def bucket_starts(keys: DataFrame, cols: list[str]) -> DataFrame:
    """``keys`` (distinct ``cols`` first, their count ``n`` last) with ``start``: how many suffixes sort before theirs."""
    spark = keys.sparkSession
    parts = keys.repartitionByRange(jobs.partitions(spark), *cols).sortWithinPartitions(*cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    done = jobs.cut(parts.mapInArrow(_running, f"{schema}, start long, part int"))
    # one row for each partition: where its keys start
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = done.groupBy("part").agg(F.sum("n").alias("sum")).select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    return done.join(offsets, "part").withColumn("start", F.col("start") + F.col("offset")).drop("part", "offset")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, copy, pos, len): runs of lines of which an earlier copy exists; ``docs`` has doc_id, copy and text."""
    spark = docs.sparkSession
    lines = docs.where("doc_id is not null").mapInArrow(_lines, "doc_id long, copy long, pos int, rank long").distinct()
    # an interval of one-line prefixes for each line id that occurs twice
    # written first, so that the join deals both sides anew and Spark can split a line that very many texts have
    often = jobs.cut(lines.groupBy("rank").agg(F.min(F.struct(*_KEY, "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    active = jobs.cut(lines.join(often, "rank").select(*_KEY, "pos", "rank", "first"))
    runs = spark.createDataFrame([], "doc_id long, copy long, pos int, len int")
    length = 1
    while active.limit(1).count():
        if length >= min_lines:
            runs = runs.union(active.where(F.struct(*_KEY, "pos") != F.col("first")).select(*_KEY, "pos", F.lit(length).alias("len")))
        shifts = [min(length, min_lines - length)] if length < min_lines else [length, 2 * length, 3 * length]
        near = Window.partitionBy(*_KEY).orderBy("pos")
        cols = ["rank", *(f"r{s}" for s in shifts)]
        wide = active.select(*_KEY, "pos", "rank", *(F.max("rank").over(near.rangeBetween(s, s)).alias(f"r{s}") for s in shifts)).na.drop(subset=cols)
        wide = jobs.cut(wide)
        keys = wide.groupBy(*cols).agg(F.min(F.struct(*_KEY, "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
        ranked = jobs.cut(bucket_starts(keys, cols).select(*cols, "first", F.col("start").alias("new")))
        active = jobs.cut(wide.join(ranked, cols).select(*_KEY, "pos", F.col("new").alias("rank"), "first"))
        length += shifts[-1]
    return runs


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text (second last column) without the runs in the last column, which gives way to the number of lines deleted."""
    for batch in batches:
        text, runs = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        gone = np.zeros(len(text), np.int64)
        if runs.null_count < len(runs):
            out = text.to_pylist()
            for i in np.flatnonzero(pc.is_valid(runs)):
                raw = out[i].split("\n")
                at = [k for k, line in enumerate(raw) if line.strip(" \t\n\v\f\r")]
                drop = {at[p] for r in runs[int(i)].as_py() for p in range(r["start"], r["stop"])}
                out[i] = "\n".join(line for k, line in enumerate(raw) if k not in drop)
                gone[i] = len(drop)
            text = pa.array(out, text.type)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], text, pa.array(gone)], names=[*batch.schema.names[:-2], "text", "_gone"])


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", deleted: str | None = None) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text; ``deleted`` names a column for the number of lines that went."""
    jobs.small_batches(docs.sparkSession)
    keyed = jobs.with_doc_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    ranges = repeated_runs(keyed, min_lines).select(*_KEY, F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("stop"))
    by_doc = jobs.cut(jobs.merged_ranges(ranges, _KEY, "_runs").select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "_runs"))
    entries = by_doc.agg(F.sum(F.size("_runs"))).first()[0] or 0
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_copy"), F.col(text_col).alias("text"))
    joined = jobs.attach(rows, by_doc, ["_id", "_copy"], entries).select(*(f"c{i}" for i in range(len(rest))), "text", "_runs")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1]) + ", `_gone` long"
    out = joined.mapInArrow(_without, schema)
    names = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(rest)} | {text_col: F.col("text").alias(text_col)}
    return out.select(*(names[c] for c in docs.columns), *([F.col("_gone").alias(deleted)] if deleted else []))
