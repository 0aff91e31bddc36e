"""Substring dedup by sliding sentence spans.

Words are runs of bytes other than white space, compared after lower-casing A-Z. A sentence ends with a word that ends in
``.``, ``!`` or ``?``, or at a line feed. From every sentence a run of ``run`` consecutive sentences starts, and besides it
the shorter run that already holds ``long`` words, so that a long sentence is a run too; runs under ``least`` words don't count (0 counts all). All runs
of all texts are hashed to 128 bits and joined globally; every run of which an earlier one (by doc_id, then place) exists is removed, sentence by sentence.

Why ``least`` is 12 by default: on 47,257 different texts of the check tables, 880,744 of the 996,643 later runs that there are without it hold three to five
words, which are "sentences" of one word in junk texts; the runs of 12 words or more are 102,989.

Scale. A task packs its runs by hash into buckets. Of equal runs within a task only the first can be the first
of all, so the later ones are marked at once and travel in a bucket by document: a run that is in a third of all documents
makes one row a task under its own hash. A bucket is sorted as arrays in one task; there is one for about every
``BUCKET_CHARS`` characters of text.

Defined cases: null and empty texts have no sentence and are not listed; a text with fewer than RUN sentences left is a
shorter run if it reaches the text's start, else runs end with the text; a text wholly repeated becomes empty; rows with a null doc_id take no
part; repeated rows of a doc_id and text are one document; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import jobs
from plinth.llm.kernels import SPACE, U64, Tokens, cut_ranges, mix, signed, spans, text_chunks

#: Sentences of a run, words of the shorter one, and words that a run needs to count.
RUN, LONG, LEAST = 3, 40, 12
BUCKET_CHARS = 8_000_000
_FLUSH = 2_000_000


def sentences(data: np.ndarray, offs: np.ndarray) -> tuple[Tokens, np.ndarray]:
    """Words of a chunk, and the index of each sentence's first word (one more at the end)."""
    t = Tokens(data, offs, SPACE)
    n = len(t.start)
    feeds = np.zeros(len(data) + 1, np.int64)
    np.cumsum(t.data == 0x0A, out=feeds[1:])
    closes = np.isin(t.data[t.end - 1], np.frombuffer(b".!?", np.uint8))
    first = np.ones(n, bool)
    first[1:] = closes[:-1] | (feeds[t.start[1:]] > feeds[t.end[:-1]]) | (t.doc[1:] != t.doc[:-1])
    return t, np.append(np.flatnonzero(first), n)


def sentence_runs(data: np.ndarray, offs: np.ndarray, run: int = RUN, long: int = LONG, least: int = LEAST) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, sentence starts, and for each run its first sentence, the sentence after its last one, and its two hashes."""
    t, at = sentences(data, offs)
    m = len(at) - 1
    doc = t.doc[at[:-1]]
    last = np.searchsorted(doc, doc, side="right")  # end of the text, in sentences
    s = np.arange(m)
    full = np.minimum(s + run, last)
    end = full
    for k in range(run - 1, 0, -1):
        stop = np.minimum(s + k, last)
        end = np.where(at[stop] - at[s] >= long, stop, end)
    early = end < full
    s, end, last = (np.concatenate(x) for x in ((s, s[early]), (full, end[early]), (last, last[early])))
    begin = np.searchsorted(doc, doc[s], side="left")
    whole = (end - s == run) | (at[end] - at[s] >= long) | ((s == begin) & (end == last))
    keep = whole & (at[end] - at[s] >= least)
    s, end = s[keep], end[keep]
    h = t.hashes()
    return t, at, s, end, spans(h, at[s], at[end]), spans(mix(h, 91), at[s], at[end])


def _pack(cols: list[np.ndarray]) -> bytes:
    return np.ascontiguousarray(np.concatenate([c.view(np.uint8).reshape(len(c), -1) for c in cols], axis=1).T).tobytes()


def _distinct(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Columns (two hashes, document, copy, place, end) sorted, each row once (a repeated row is one document)."""
    order = np.lexsort(cols[4::-1])
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols[:5]], axis=0)
    return [c[new] for c in cols]


def _again(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which sorted rows have the hashes of the row before."""
    out = np.zeros(len(h), bool)
    out[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    return out


def _rows(table: pa.Table) -> list[np.ndarray]:
    """The columns of a bucket's packs."""
    rows = np.concatenate([np.ascontiguousarray(np.frombuffer(x.as_py(), np.uint8).reshape(40, -1).T) for x in table.column("rows")])
    kinds = ((0, 8, U64), (8, 8, U64), (16, 8, np.int64), (24, 8, np.int64), (32, 4, np.int32), (36, 4, np.int32))
    return [np.ascontiguousarray(rows[:, i : i + n]).view(k).ravel() for i, n, k in kinds]


def _emit(buckets: int, run_of: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, g, doc, copy, pos, end = _distinct([np.concatenate(x) for x in zip(*held, strict=True)])
            later = _again(h, g)
            where = np.where(later, mix(doc.view(U64) ^ pos.astype(U64)), h) % U64(buckets)
            h = np.where(later, U64(0), h | U64(1))
            order = np.argsort(where, kind="stable")
            at = np.concatenate((np.flatnonzero(np.concatenate(([True], np.diff(where[order]) != 0))), [len(order)])) if len(order) else np.array([0])
            cols = [x[order] for x in (h, g, doc, copy, pos, end)]
            yield pa.RecordBatch.from_arrays([pa.array(where[order][at[:-1]].astype(np.int32)), pa.array([_pack([c[x:y] for c in cols]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["bucket", "rows"])

        n = 0
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, data, offs in text_chunks(batch.column(2)):
                t, at, s, end, h, g = sentence_runs(data, offs, *run_of)
                d = t.doc[at[s]]
                base = np.searchsorted(t.doc[at[:-1]], d) if len(s) else s
                held.append((h, g, ids[a:b][d], copies[a:b][d], (s - base).astype(np.int32), (end - base).astype(np.int32)))
                n += len(h)
                if n > _FLUSH:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return run


def _later(table: pa.Table) -> pa.Table:
    """(doc_id, copy, pos, end) of the runs in a bucket that are not the first of their hash."""
    h, g, doc, copy, pos, end = _distinct(_rows(table))
    keep = (h == 0) | _again(h, g)
    return pa.table({"doc_id": doc[keep], "copy": copy[keep], "pos": pos[keep], "end": end[keep]})


def later_runs(docs: DataFrame, run: int = RUN, long: int = LONG, least: int = LEAST) -> DataFrame:
    """(doc_id, copy, pos, end): runs of sentences that an earlier place has too; ``docs`` has doc_id, copy and text."""
    rows = docs.where("doc_id is not null and text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(max(16, chars // BUCKET_CHARS))
    found = rows.mapInArrow(_emit(buckets, (run, long, least)), "bucket int, rows binary").groupBy("bucket").applyInArrow(_later, "doc_id long, copy long, pos int, end int")
    return found.distinct()


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            ((_, _, data, offs),) = text_chunks(batch.column(1).slice(i, 1))
            t, at = sentences(data, offs)
            gone = sorted({k for r in batch.column(2)[i].as_py() for k in range(r["start"], r["stop"])})
            stops = np.append(t.start, len(data))[at]
            out.append((batch.column(0)[i].as_py(), len(at) - 1, len(gone), cut_ranges(data.tobytes(), [(int(stops[k]), int(stops[k + 1])) for k in gone]).decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())], names=["doc_id", "n_sentences", "n_removed", "text"])


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long: int = LONG, least: int = LEAST) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) of every document that loses sentences, with the text that is left."""
    jobs.small_batches(docs.sparkSession)
    keyed = jobs.with_doc_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    found = later_runs(keyed, run, long, least).select("doc_id", "copy", F.col("pos").alias("start"), F.col("end").alias("stop"))
    runs = jobs.cut(jobs.merged_ranges(found, ["doc_id", "copy"], "runs"))
    n = runs.agg(F.sum(F.size("runs"))).first()[0] or 0
    joined = keyed.join(F.broadcast(runs) if n <= jobs.BROADCAST_IDS else runs, ["doc_id", "copy"]).dropDuplicates(["doc_id", "copy"])
    return joined.select("doc_id", "text", "runs").mapInArrow(_without, "doc_id long, n_sentences long, n_removed long, text string")
