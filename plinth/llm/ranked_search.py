"""Ranked lexical search over shards of compressed postings, document at a time.

Index. A task takes its texts by about ``SHARD_BYTES`` (whole texts, at most ``SHARD_DOCS`` of them) as a shard: the documents are numbered in the order of doc_id, and
every term of the shard gets one row with its postings, (gap to the document before, occurrences) as bytes of seven bits. One more row of the shard holds its
doc_ids and lengths. Shards are whole for themselves, so texts are never shuffled, and a very common term is one short row in each shard.

Statistics (documents, terms, documents with a term) are sums over the index rows, for the terms of the queries only.

Search. Queries go in blocks of ``BLOCK`` items; a block meets a shard through the terms that they share. In that group the postings of an item's
terms are merged document at a time: a heap holds a cursor for each term by the next document it stands on; those that stand inside the next ``WINDOW``
documents are taken from the heap, their postings up to the window's end are scored as vectors and summed by document, and they go back on to the
heap at the document after. The best ``k`` of the item are kept in a heap bounded by k, worst on top, by score and then doc_id; a window's documents below
that one are passed over at once. Each shard gives at most k documents an item, and a global merge ranks them.

Scores are 64-bit integers, exactly as defined in ``search``.

Defined cases: rows with a null doc_id or item_id are left out; null texts and texts without terms take no part (they count in no statistic); repeated rows of documents are
documents of their own, with ranks of their own; repeated rows of an item_id are one item, the terms of its distinct texts together;
an empty table of documents or items gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm import jobs
from plinth.llm.kernels import NON_WORD, Tokens, text_chunks

K = 20
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Items of a block of queries, and documents of a window of the merge.
BLOCK, WINDOW = 256, 4096
#: Terms of the queries that are broadcast to the index, counted first.
BROADCAST_TERMS = 200_000
_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_INDEX = "shard long, term string, n_docs long, n_terms long, postings binary"


# ------------------------------------------------------------------ bytes of seven bits


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other, low bits first, and the number of bytes of each; the top bit says that more follow."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for b in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * b)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for b in range(int(size.max(initial=0))):
        k = np.flatnonzero(size > b)
        out[at[k] + b] = (v[k] >> np.uint64(7 * b)).astype(np.uint8) & 127 | np.where(size[k] > b + 1, 128, 0).astype(np.uint8)
    return out, size


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
    size = ends - starts + 1
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(size.max(initial=0))):
        i = np.flatnonzero(size > k)
        out[i] |= (b[starts[i] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def _blobs(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Slices of ``data`` of the given sizes, as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


# ------------------------------------------------------------------ index


def _terms(data: np.ndarray, offs: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of a chunk of texts, and the row of each."""
    t = Tokens(data, offs, NON_WORD)
    inside = np.zeros(len(t.data) + 1, np.int8)
    np.add.at(inside, t.start, 1)
    np.add.at(inside, t.end, -1)
    kept = t.data[np.cumsum(inside[:-1]).astype(bool)]
    ends = np.concatenate(([0], np.cumsum(t.end - t.start)))
    return pa.Array.from_buffers(pa.large_string(), len(t.start), [None, pa.py_buffer(ends), pa.py_buffer(kept)]).dictionary_encode(), t.doc


class _Shard:
    """Documents on the way to a shard: ids, lengths, and (term, document, occurrences)."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs = self.bytes = 0

    def add(self, ids: np.ndarray, data: np.ndarray, offs: np.ndarray) -> None:
        terms, doc = _terms(data, offs)
        m = len(ids)
        codes = np.asarray(terms.indices).astype(np.int64)
        key, tf = np.unique(codes * m + doc, return_counts=True)
        self.parts.append((terms.dictionary, key // m, key % m + self.docs, tf))
        self.ids.append(ids)
        self.lengths.append(np.bincount(doc, minlength=m))
        self.docs += m
        self.bytes += len(data)

    def rows(self, shard: int) -> pa.RecordBatch:
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        kept = np.flatnonzero(lengths)
        kept = kept[np.argsort(ids[kept], kind="stable")]
        place = np.zeros(len(ids), np.int64)
        place[kept] = np.arange(len(kept))
        words = pa.chunked_array([p[0] for p in self.parts]).combine_chunks().dictionary_encode()
        codes = np.asarray(words.indices).astype(np.int64)
        first = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        term = np.concatenate([codes[a + p[1]] for a, p in zip(first, self.parts, strict=False)])
        doc, tf = place[np.concatenate([p[2] for p in self.parts])], np.concatenate([p[3] for p in self.parts])
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        new = np.concatenate(([True], term[1:] != term[:-1])) if len(term) else np.zeros(0, bool)
        gap = np.where(new, doc, doc - np.concatenate(([0], doc[:-1])))
        data, size = pack(np.stack((gap, tf), axis=1).ravel())
        starts = np.flatnonzero(new)
        by_term = np.add.reduceat(size, 2 * starts) if len(starts) else np.zeros(0, np.int64)
        df = np.diff(np.concatenate((starts, [len(term)])))
        # doc_ids as gaps too; the first and its sign come first
        low = int(ids[kept[0]]) if len(kept) else 0
        head, _ = pack(np.concatenate(([abs(low), low < 0], np.diff(ids[kept].astype(np.int64)) if len(kept) else np.zeros(0, np.int64), lengths[kept])))
        n = len(starts) + 1
        blobs = _blobs(np.concatenate((data, head)), np.concatenate((by_term, [len(head)])))
        names = pa.concat_arrays([words.dictionary.take(pa.array(term[starts])).cast(pa.string()), pa.nulls(1, pa.string())])
        cols = [pa.array(np.full(n, shard)), names, pa.array(np.concatenate((df, [len(kept)]))), pa.array(np.concatenate((np.zeros(n - 1, np.int64), [int(lengths.sum())]))), blobs]
        return pa.RecordBatch.from_arrays(cols, names=["shard", "term", "n_docs", "n_terms", "postings"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, number = _Shard(), TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for a, b, data, offs in text_chunks(batch.column(1)):
            shard.add(ids[a:b], data, offs)
            if shard.bytes >= SHARD_BYTES or shard.docs >= SHARD_DOCS:
                yield shard.rows(number)
                shard, number = _Shard(), number + 1
    if shard.docs:
        yield shard.rows(number)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text) as a written table: a row for each term of each shard, and one with a null term for its documents."""
    jobs.small_batches(docs.sparkSession)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return jobs.cut(texts.mapInArrow(_index, _INDEX))


# ------------------------------------------------------------------ search


def _documents(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    v = unpack(blob)
    low = -v[0] if v[1] else v[0]
    return low + np.concatenate(([0], np.cumsum(v[2 : n + 1]))), v[n + 1 :]


class _Cursor:
    """The postings of a term in a shard, from the document it stands on."""

    def __init__(self, blob: bytes, weight: int, m: np.ndarray):
        v = unpack(blob)
        self.doc, tf = np.cumsum(v[::2]), v[1::2]
        self.score = weight * (1_000_000_000 * tf // (1000 * tf + 12 * m[self.doc]))


def best(cursors: list[tuple[_Cursor, int]], ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The ``k`` best (score, -doc_id) of the documents that (cursor, times in the query) reach, by a merge over a heap of cursors."""
    at = [0] * len(cursors)
    heads = [(int(c.doc[0]), i) for i, (c, _) in enumerate(cursors) if len(c.doc)]
    heapq.heapify(heads)
    top: list[tuple[int, int]] = []
    sums = np.zeros(WINDOW, np.int64)
    while heads:
        low = heads[0][0]
        while heads and heads[0][0] < low + WINDOW:
            _, i = heapq.heappop(heads)
            c, times = cursors[i]
            end = at[i] + int(np.searchsorted(c.doc[at[i] :], low + WINDOW))
            sums[c.doc[at[i] : end] - low] += times * c.score[at[i] : end]
            at[i] = end
            if end < len(c.doc):
                heapq.heappush(heads, (int(c.doc[end]), i))
        floor = top[0][0] if len(top) == k else 1
        found = np.flatnonzero(sums >= max(1, floor))
        if len(found) > k:
            # ids rise with the place, so of equal scores the earlier ones stay
            found = found[np.lexsort((found, -sums[found]))[:k]]
        for d in found:
            entry = (int(sums[d]), -int(ids[low + d]))
            if len(top) < k:
                heapq.heappush(top, entry)
            elif entry > top[0]:
                heapq.heapreplace(top, entry)
        sums[:] = 0
    return top


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["term"] is None)
        ids, n = _documents(head["postings"], head["n_docs"])
        m = 75 + 25 * n * head["all_docs"] // head["all_terms"]
        items: dict[int, list[tuple[_Cursor, int]]] = {}
        for r in rows:
            if r["term"] is not None:
                c = _Cursor(r["postings"], r["weight"], m)
                for use in r["uses"]:
                    items.setdefault(use["item_id"], []).append((c, use["times"]))
        out = [(item, -d, s) for item, cursors in items.items() for s, d in best(cursors, ids, k)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("item_id", "doc_id", "score"), cols, strict=True)})

    return run


def search(index: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of ``index`` that score highest for each of ``items`` (item_id, text).

    Of N documents with terms, L terms in all and df documents with a term, the term weighs w = floor(1000 * ln((2 N + 2) / (2 df + 1))). A document of n terms, tf of them
    this one, gets w * (10^9 tf div (1000 tf + 12 m)) with m = 75 + 25 n N div L, summed over the item's terms with repeats. Equal scores go by doc_id.
    """
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    terms = texts.select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(_PATTERN), F.lit(0))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))
    number = texts.select("item_id").distinct().count()
    blocks = max(1, -(-number // BLOCK))
    uses = jobs.cut(terms.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"), "term").agg(F.collect_list(F.struct("item_id", "times")).alias("uses")))
    whole = index.where("term is null").agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n, total = whole.docs or 0, whole.terms or 0
    wanted = uses.select("term").distinct()
    few = wanted.count() <= BROADCAST_TERMS
    small = F.broadcast if few else (lambda df: df)
    # written, so that postings of the queries' terms are read from the index once
    found = jobs.cut(index.where("term is not null").join(small(wanted), "term", "left_semi"))
    weights = found.groupBy("term").agg(F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.sum("n_docs") + 1))).cast("long").alias("weight"))
    asked = uses.join(weights, "term")
    numbers = [F.lit(n).cast("long").alias("all_docs"), F.lit(total).cast("long").alias("all_terms")]
    # weights of 0 add nothing to a score
    met = found.join(small(asked.where("weight > 0")), "term").select("shard", "block", "term", "n_docs", "postings", "weight", "uses", *numbers)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    heads = index.where("term is null").select("shard", every, "term", "n_docs", "postings", F.lit(None).cast("long").alias("weight"), F.lit(None).cast(met.schema["uses"].dataType).alias("uses"), *numbers)
    best_of_shards = met.union(heads).groupBy("shard", "block").applyInArrow(_search(k), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return best_of_shards.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
