"""Spelling variants: words one edit apart, found by rolling hashes of their deletions.

Words are the runs of letters of all texts (with a stated rule that damages some of them by one deleted letter), counted by word. Two
words differ by one replaced letter if they are equal after the letter at one same place of both is deleted, and by one inserted or deleted letter if one of them
is what the other is after a deletion. So every word is laid out under its own hash and under the hashes of all its deletions: with polynomial hashes of its
prefixes and suffixes, the hash of a word without its letter i is hash(prefix i) + hash(suffix i + 1) / base, which NumPy takes for all letters of a batch of words at once.
Of a run of equal letters only the first is deleted for insertions, so a pair of words meets under one key only.

Keys are integers of 64 bits. They are dealt by their top bits (a radix partition) into buckets of about ``BUCKET`` keys, each sorted by key; keys that stand alone are passed over, and where several meet their strings
are compared, so a collision of hashes changes nothing. Under one key there are at most as many words as there are letters in the alphabet, so that no group can grow with the corpus;
a key gives each of its words the number of near words and the best one, never pairs. Sums and maxima by word follow.

A word's form points at a word at least five times as frequent, so chains have at most log5(largest count) links; roots are found by doubling the pointers, in a number of joins known before.

Defined cases: null and empty texts have no words; rows with a null doc_id are left out; repeated rows of documents count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import jobs
from plinth.llm.kernels import SPACE, Tokens, mix, text_chunks

LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many, by its hash, loses a letter.
DAMAGED = 199
#: Keys of a bucket.
BUCKET = 200_000
_WHOLE = -1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPREAD = np.random.default_rng(7).integers(1, 1 << 63, 0x110000 >> 8, dtype=np.uint64)


# ------------------------------------------------------------------ words


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each slice of ``data``, carried on from the crc32 ``before`` it."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    start, size, crc = start[order], size[order], ~before[order].astype(np.uint32)
    short = int(np.searchsorted(-size, -64))
    out = np.empty(len(size), np.uint32)
    # long ones by themselves: rare, and each would hold up all others
    for i in range(short):
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes(), int(~crc[i]))
    start, left, crc = start[short:], size[short:], crc[short:]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j))
        c = crc[:n]
        crc[:n] = _CRC[(c ^ data[start[:n] + j]) & 255] ^ (c >> 8)
    out[short:] = ~crc
    back = np.empty_like(out)
    back[order] = out
    return back


def _runs(data: np.ndarray, offs: np.ndarray) -> Tokens:
    """Runs of ASCII letters and of U+00C0 to U+00FF, whose UTF-8 form is C3 and one more byte; lower-cased in ASCII."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
    lead = data == 0xC3
    letter = ascii_letter | lead
    letter[1:] |= lead[:-1]
    return Tokens(np.where(letter, data, 32).astype(np.uint8), offs, SPACE)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for a, b, data, offs in text_chunks(batch.column(1), 4 << 20):
            t = _runs(data, offs)
            follow = np.concatenate(([0], np.cumsum((t.data & 0xC0) != 0x80)))
            letters = follow[t.end] - follow[t.start]
            keep = letters >= LEAST_LETTERS
            start, end, doc, letters = t.start[keep], t.end[keep], t.doc[keep], letters[keep]
            head = np.array([zlib.crc32(b"%d:" % i) for i in ids[a:b]], np.uint32)
            h = crc32(t.data, start, end, head[doc]).astype(np.int64)
            hurt = h % DAMAGED == 0
            size = (end - start)[~hurt]
            at = np.repeat(start[~hurt] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            plain = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), pa.py_buffer(t.data[at])])
            found = plain.value_counts()
            words, counts = found.field(0).cast(pa.string()), found.field(1).cast(pa.int64())
            odd = []
            for i in np.flatnonzero(hurt & (letters > LEAST_LETTERS)):
                w = t.data[start[i] : end[i]].tobytes().decode()
                k = int(h[i] % len(w))
                odd.append(w[:k] + w[k + 1 :])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array(odd, pa.string())]), pa.concat_arrays([counts, pa.array([1] * len(odd), pa.int64())])], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) with enough letters and occurrences."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = texts.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


# ------------------------------------------------------------------ keys


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after the other, and where each word starts (one more at the end)."""
    words = column.to_pylist()
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)


def deletion_keys(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, hash of each word without each of its letters)."""
    n, count = len(points), len(first) - 1
    word = np.repeat(np.arange(count), np.diff(first))
    place = np.arange(n) - first[word]
    longest = int(np.diff(first).max(initial=0))
    power = np.full(longest + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    terms = mix(points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + _SPREAD[points >> 8]) * power[place]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    total = sums[first[1:]] - sums[first[:-1]]
    prefix = sums[:n] - sums[first[word]]
    suffix = sums[first[word + 1]] - sums[1:]
    size = np.diff(first).astype(np.uint64)
    return mix(total + size), mix(prefix + suffix * np.uint64(_INVERSE) + size[word] - np.uint64(1))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # few words at a time, whatever their length
        for a, b, _, _ in text_chunks(batch.column(0), 1 << 18):
            words, n = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
            points, first = _letters(words)
            whole, without = deletion_keys(points, first)
            word = np.repeat(np.arange(b - a), np.diff(first))
            place = np.concatenate((np.full(b - a, _WHOLE), np.arange(len(points)) - first[word])).astype(np.int32)
            at = pa.array(np.concatenate((np.arange(b - a), word)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((whole, without)).view(np.int64)), pa.array(place), words.take(at), n.take(at)], names=["key", "place", "word", "n"])


def _meet(table: pa.Table) -> pa.Table:
    """(word, near, best_n, best) of the words that meet under the keys of a bucket."""
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    alone = np.ones(len(key), bool)
    alone[1:] &= key[1:] != key[:-1]
    alone[:-1] &= key[1:] != key[:-1]
    table, key = table.take(pa.array(order[~alone])), key[~alone]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    words, places, counts = (table.column(c).to_pylist() for c in ("word", "place", "n"))
    out = []
    for a, b in zip(starts, [*starts[1:], len(words)], strict=False):
        # strings under a key, as the key can stand for several: the whole word, and words that deletions take to it
        wholes: dict[str, int] = {}
        cut = defaultdict(list)
        for i in range(a, b):
            w, p = words[i], places[i]
            if p == _WHOLE:
                wholes[w] = counts[i]
            else:
                cut[w[:p] + w[p + 1 :]].append((w, p, counts[i]))
        for s, longer in cut.items():
            near = defaultdict(list)
            for w, p, n in longer:
                near[p].append((-n, w))
            for group in near.values():
                out += _near(group)
            if s in wholes:
                # one deletion of a run of equal letters
                group = sorted((-n, w) for w, p, n in longer if p == 0 or w[p - 1] != w[p])
                out.append((s, len(group), -group[0][0], group[0][1]))
                out += [(w, 1, wholes[s], s) for _, w in group]
    cols = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.table({"word": pa.array(cols[0], pa.string()), "near": pa.array(cols[1], pa.int64()), "best_n": pa.array(cols[2], pa.int64()), "best": pa.array(cols[3], pa.string())})


def _near(group: list[tuple[int, str]]) -> list[tuple[str, int, int, str]]:
    """Each word of a group of (-n, word) with the best of the others."""
    if len(group) < 2:
        return []
    first, second = sorted(group)[:2]
    return [(w, len(group) - 1, -(o := second if (n, w) == first else first)[0], o[1]) for n, w in group]


# ------------------------------------------------------------------ variants


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n), distinct: the near word of largest n (then first in code-point order) is the form if its n is ``ratio`` times the word's."""
    spark = words.sparkSession
    words = jobs.cut(words.select("word", "n"))
    size = words.agg(F.sum(F.length("word") + 1).alias("keys"), F.max("n").alias("top")).first()
    keys, top = size.keys or 0, size.top or 1
    bits = max(0, math.ceil(math.log2(max(1, keys / BUCKET, min(2 * jobs.partitions(spark), keys / 1000)))))
    laid = words.mapInArrow(_keys, "key long, place int, word string, n long")
    bucket = F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0)
    met = laid.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_meet, "word string, near long, best_n long, best string")
    best = met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b"))
    strong = -F.col("b.n") >= ratio * F.col("n")
    formed = jobs.cut(
        words.join(best, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("b.best")).alias("form"), F.when(strong, -F.col("b.n")).alias("form_n"))
    )
    # pointers over 1, 2, 4, ... links; a chain has at most log(top) of them
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    rounds = max(1, math.ceil(math.log2(max(2.0, math.log(max(top, 2), ratio)))))
    for _ in range(rounds):
        links = jobs.cut(links.join(links.select(F.col("word").alias("root"), F.col("root").alias("after")), "root", "left").select("word", F.coalesce("after", "root").alias("root")))
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants of the words of ``docs`` (doc_id, text)."""
    jobs.small_batches(docs.sparkSession)
    return variants(word_counts(docs))
