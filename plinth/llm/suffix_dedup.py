"""Suffix-array dedup: suffixes whose minimiser place recurs, sorted in buckets by their first words, and all but the first of each interval removed.

Words are runs of bytes other than white space, compared after lower-casing A-Z. In every ``WINDOW`` neighbouring ``GRAM``-word
grams the one with the smallest hash is selected (the last of equal ones), so any two equal passages of
``WINDOW + GRAM - 1`` words select the same place inside; about one in ``WINDOW / 2`` words is such a place.

Two passages of ``LEAST`` (50) words can be equal only if ``PREFIX`` words from their own place, the one that their first
``WINDOW`` grams select, are equal: places whose prefix is unique are left out by a count with partial sums. Every suffix whose own place is left
and that holds ``LEAST`` words is sorted by the hash of those words; suffixes of one hash are an interval of the suffix array with a common prefix
of ``LEAST`` words or more (hashes of 128 bits). In each interval the first suffix (by doc_id, then place) stays, and the ``LEAST`` words that every other one starts with
are removed. The union of these over all suffixes is every repeated passage of LEAST words or more of which an earlier copy exists, in whole families too
whose members match each other further than they match the first.

Later copies of a whole text of LEAST words are removed whole, and only its first takes part.

Scale. A task packs its suffixes by the hash of their own place's prefix into buckets, so that neighbours in a text mostly travel and come back
as one range. Of equal suffixes within a task only the first can be the first of all, so the later ones are marked at once and travel in a
bucket by document: a passage that is in a third of all documents makes one row a task under its own hash. A bucket is sorted as arrays in one task;
there is one for about every ``BUCKET_CHARS`` characters of text.

Defined cases: null and empty texts and texts under PREFIX words match nothing; a text wholly repeated becomes empty;
rows with a null doc_id take no part; repeated rows of a doc_id and text are one document; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import jobs
from plinth.llm.kernels import SPACE, U64, Tokens, cut_ranges, mix, runs, signed, spans, text_chunks
from plinth.llm.substring_dedup import _again, _distinct, _pack, _rows

GRAM, WINDOW, PREFIX, LEAST = 8, 25, 24, 50
BUCKET_CHARS = 8_000_000
_FLUSH = 2_000_000
_ALL = 2**31 - 1


def owned(words: Tokens, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word indices of the suffixes that hold LEAST words of their text, and the minimiser place that each one's first grams select."""
    n = len(h)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(words.doc[: n - LEAST + 1] == words.doc[LEAST - 1 :])
    g = mix(runs(h, GRAM), 21)
    m = len(g)
    view = np.lib.stride_tricks.sliding_window_view(g[::-1], WINDOW)
    low = m - 1 - (np.arange(m - WINDOW + 1) + view.argmin(axis=1))  # the last of equal ones
    return start, low[::-1][start]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in text_chunks(batch.column(2)):
            t = Tokens(data, offs, SPACE)
            h = t.hashes()
            at = np.unique(owned(t, h)[1])
            key = runs(h, PREFIX)[at] if len(at) else at
            doc = pa.array(t.doc[at])
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), batch.column(0).slice(a, b - a).take(doc), batch.column(1).slice(a, b - a).take(doc), pa.array((at - t.first[t.doc[at]]).astype(np.int32))], names=["h", "doc_id", "copy", "pos"])


def _emit(buckets: int):
    """Packs of (hash of LEAST words or 0, document key, document copy, first word, word after the last) of the suffixes whose own place is listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, g, doc, copy, pos, place, prefix = _distinct([np.concatenate(x) for x in zip(*held, strict=True)])
            later = _again(h, g)
            where = np.where(later, mix(doc.view(U64) ^ place.astype(U64)), prefix) % U64(buckets)
            h = np.where(later, U64(0), h | U64(1))
            order = np.lexsort((pos, copy, doc, where))
            where = where[order]
            at = np.concatenate((np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))), [len(where)]))
            cols = [x[order] for x in (h, g, doc, copy, pos, (pos + LEAST).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(where[at[:-1]].astype(np.int32)), pa.array([_pack([c[x:y] for c in cols]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["bucket", "rows"])

        n = 0
        for batch in batches:
            ids, copies, listed = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for a, b, data, offs in text_chunks(batch.column(2)):
                t = Tokens(data, offs, SPACE)
                words = t.hashes()
                start, place = owned(t, words)
                mine = listed.slice(a, b - a)
                known = np.zeros(len(words) + 1, bool)
                known[np.repeat(t.first[:-1], pc.list_value_length(mine).to_numpy(zero_copy_only=False)) + mine.flatten().to_numpy()] = True
                start, place = start[known[place]], place[known[place]]
                d = t.doc[start]
                first = t.first[d]
                held.append((spans(words, start, start + LEAST), spans(mix(words, 91), start, start + LEAST), ids[a:b][d], copies[a:b][d], (start - first).astype(np.int32), place - first, spans(words, place, place + PREFIX)))
                n += len(start)
                if n > _FLUSH:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return run


def _later(table: pa.Table) -> pa.Table:
    """(doc_id, copy, start, stop): the words of a bucket's suffixes that are not the first of their interval, as ranges."""
    h, g, doc, copy, pos, end = _distinct(_rows(table))
    keep = np.flatnonzero((h == 0) | _again(h, g))
    keep = keep[np.lexsort((pos[keep], copy[keep], doc[keep]))]
    doc, copy, pos, end = (x[keep] for x in (doc, copy, pos, end))
    # all are of one length, so ranges that touch follow each other
    new = np.ones(len(keep), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (pos[1:] > end[:-1])
    at = np.flatnonzero(new)
    return pa.table({"doc_id": doc[at], "copy": copy[at], "start": pos[at], "stop": end[np.append(at[1:], len(keep)) - 1] if len(at) else end})


def later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, start, stop): ranges of words that an earlier copy has; ``docs`` has doc_id, copy and text."""
    rows = docs.where("doc_id is not null and text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(max(16, chars // BUCKET_CHARS))
    whole = rows.select("doc_id", "copy", F.md5("text").alias("text_key"))
    first = whole.groupBy("text_key").agg(F.min(F.struct("doc_id", "copy")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = jobs.cut(whole.join(first, "text_key").where(F.struct("doc_id", "copy") != F.col("first")).select("doc_id", "copy").distinct())
    rows = rows.join(F.broadcast(later) if later.count() <= jobs.BROADCAST_IDS else later, ["doc_id", "copy"], "left_anti")
    places = rows.mapInArrow(_places, "h long, doc_id long, copy long, pos int")
    # written first, so that the join deals both sides anew and Spark can split a prefix that very many places have
    often = jobs.cut(places.groupBy("h").count().where("count > 1").select("h"))
    kept = jobs.cut(places.join(often, "h", "left_semi").groupBy("doc_id", "copy").agg(F.collect_set("pos").alias("at")))
    near = jobs.semi(rows, kept.select("doc_id"), "doc_id").join(kept, ["doc_id", "copy"]).dropDuplicates(["doc_id", "copy"])
    packs = near.select("doc_id", "copy", "text", "at").mapInArrow(_emit(buckets), "bucket int, rows binary")
    found = packs.groupBy("bucket").applyInArrow(_later, "doc_id long, copy long, start int, stop int")
    copies = later.select("doc_id", "copy", F.lit(0).alias("start"), F.lit(_ALL).alias("stop"))
    return copies.union(found)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            ((_, _, data, offs),) = text_chunks(batch.column(1).slice(i, 1))
            t = Tokens(data, offs, SPACE)
            stops = np.append(t.start, len(data))
            gone = np.zeros(len(t.start) + 1, np.int64)
            n = len(t.start)
            ranges = [(r["start"], min(n, r["stop"])) for r in batch.column(2)[i].as_py() if r["stop"] < _ALL or n >= LEAST]
            for start, stop in ranges:
                gone[start] += 1
                gone[stop] -= 1
            removed = int((np.cumsum(gone)[:-1] > 0).sum())
            text = cut_ranges(data.tobytes(), [(int(stops[start]), int(stops[stop])) for start, stop in ranges])
            out.append((batch.column(0)[i].as_py(), len(t.start), removed, text.decode("utf-8", "replace")))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "text"])


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text) of every document that loses words, with the text that is left."""
    jobs.small_batches(docs.sparkSession)
    keyed = jobs.with_doc_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    ranges = jobs.cut(jobs.merged_ranges(later_copies(keyed), ["doc_id", "copy"], "ranges"))
    n = ranges.agg(F.sum(F.size("ranges"))).first()[0] or 0
    joined = keyed.join(F.broadcast(ranges) if n <= jobs.BROADCAST_IDS else ranges, ["doc_id", "copy"]).dropDuplicates(["doc_id", "copy"])
    return joined.select("doc_id", "text", "ranges").mapInArrow(_without, "doc_id long, n_words long, n_removed long, text string").where("n_removed > 0")
