"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are runs of bytes other than white space after lower-casing A-Z, and one end after each text. The tree's states are contexts of 0 to ``DEPTH``
tokens (inside one text). The root's distribution is the add-one unigram over the training tokens. A longer context keeps the next tokens seen after it
at least ``LEAST`` (2) times, discounted by ``DISCOUNT``, and gives the rest of its mass to the distribution of its longest retained suffix, so each state's
distribution sums to one. A context is retained if its own distribution describes its training tokens better than that suffix's by more than ``GAIN``
nats (their number times the divergence of the two). A token is scored in the state of the longest retained suffix of what stands before it.

Every count is exact and over all training tokens, and all of them stay distributed. Contexts that end in one word are one branch of the tree, and a
branch needs nothing of others but the root. So every token's place (the words before it, itself, its document) goes to the bucket of the word before
it, and a bucket grows its branches, one context length after another, and scores its places there; per-document sums come back. Of root counts only
the ``CACHE`` most frequent words' are broadcast (a bound of 7 MB), as a short cut: places whose own word is not among them first pass the bucket of that word, which adds
its count. The result is the same whatever the cache holds.

Hot words: a word with more than a bucket's share of all tokens has its places dealt to several buckets by the word before it, so only the contexts of
one word are split. Their counts are added up beforehand, in tasks, then by next word, then by context, and each of those buckets gets the
whole branch's first level.

Defined cases: null and empty texts are one token, the end; rows with a null doc_id are scored but teach nothing
and count as not held out; repeated rows teach and are scored each; without training tokens every token has probability one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import jobs
from plinth.llm.kernels import SPACE, U64, Tokens, mix, text_chunks

DEPTH = 2
LEAST = 2
DISCOUNT = 0.75
GAIN = 8.0
CACHE = 400_000
BUCKET_CHARS = 5_000_000
_FLUSH = 2_500_000
_MASK, _RARE = U64((1 << 62) - 1), 1 << 62
_END = U64(0x1BD1E995C6A4A793)
_SMALL = (1 << 24) - 1
_STEPS = 2.0**32
_BLOB = pa.schema([("bucket", pa.int32()), ("rows", pa.binary())])


def sequence(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (62 bits) of a chunk with an end after each text, and each one's row."""
    t = Tokens(data, offs, SPACE)
    rows = len(offs) - 1
    h = np.insert((t.hashes() & _MASK) | U64(1), t.first[1:], _END)
    return h, np.repeat(np.arange(rows), np.diff(t.first) + 1)


def places(ids: np.ndarray, doc: np.ndarray, depth: int) -> list[np.ndarray]:
    """The word itself, then the one before it and so on up to ``depth`` before; 0 where the text has none."""
    out = [ids]
    for k in range(1, depth + 1):
        before = np.zeros(len(ids), ids.dtype)
        before[k:] = np.where(doc[k:] == doc[:-k], ids[:-k], 0)
        out.append(before)
    return out


class Table:
    """Numbers by hash. Keys are also numbered from 1 by falling value, so that frequent words have small numbers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.by_rank = np.lexsort((self.keys, -self.values))
        self.number = np.empty(len(keys), np.int64)
        self.number[self.by_rank] = np.arange(1, len(keys) + 1)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are there, and the values of those that are (else 0)."""
        if not len(self.keys):
            return np.zeros(len(h), bool), np.zeros(len(h), self.values.dtype)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == h
        return found, np.where(found, self.values[at], 0)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """A number for each token: the one it has here, or else its hash and one bit more."""
        if not len(self.keys):
            return h.view(np.int64) | _RARE
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == h, self.number[at], h.view(np.int64) | _RARE)

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        """The hash of each number that isn't 0."""
        rare = ids >= _RARE
        return np.where(rare, ids & ~_RARE, self.keys[self.by_rank[np.where(rare, 1, ids) - 1]].view(np.int64) if len(self.keys) else 0).view(U64)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """The value of each number that is one of here, else 0."""
        return np.append(self.values[self.by_rank], 0)[np.where((ids > 0) & (ids <= len(self.keys)), ids - 1, len(self.keys))]


# ------------------------------------------------------------------ packs: columns in one compressed binary value


def _planes(col: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bytes of a column, by byte plane."""
    return np.ascontiguousarray(col.view(np.uint8).reshape(len(col), 8)[:, :width].T).tobytes()


def _unplaned(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.view(np.int64).ravel()


def _pack(cols: list[np.ndarray]) -> bytes:
    """Columns of 8 bytes: values under 2**24 as three bytes, others as a mark there and eight bytes apart."""
    parts = [np.array([len(cols[0])], np.int64).tobytes()]
    for c in cols:
        c = np.ascontiguousarray(c).view(np.int64)
        large = (c < 0) | (c >= _SMALL)
        if 2 * int(large.sum()) > len(c):
            parts += [np.array([-1], np.int64).tobytes(), _planes(c, 8)]
        else:
            parts += [np.array([large.sum()], np.int64).tobytes(), _planes(np.where(large, _SMALL, c), 3), _planes(c[large], 8)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blobs, width: int) -> list[np.ndarray]:
    """The columns (int64) of all packs."""
    parts: list[list[np.ndarray]] = [[] for _ in range(width)]
    inflate = zstandard.ZstdDecompressor()
    for blob in blobs:
        raw = np.frombuffer(inflate.decompress(blob.as_py()), np.uint8)
        n, at = int(raw[:8].view(np.int64)[0]), 8
        for k in range(width):
            large, at = int(raw[at : at + 8].view(np.int64)[0]), at + 8
            if large < 0:
                parts[k].append(_unplaned(raw[at : at + 8 * n], n, 8))
                at += 8 * n
            else:
                c = _unplaned(raw[at : at + 3 * n], n, 3)
                at += 3 * n
                if large:
                    c[c == _SMALL] = _unplaned(raw[at : at + 8 * large], large, 8)
                    at += 8 * large
                parts[k].append(c)
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def _split(where: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, buckets, edges): rows by bucket, then by a hash of ``lead``, so that equal ones stand together."""
    order = np.argsort(where.astype(U64) << U64(32) | mix(lead.view(U64), 6) >> U64(32), kind="stable")
    where = where[order]
    at = np.append(np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))), len(where)) if len(where) else np.zeros(1, np.int64)
    return order, where[at[:-1]], at


def _dealt(where: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    """A pack for each bucket."""
    order, buckets, at = _split(where, cols[0])
    cols = [c[order] for c in cols]
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array([_pack([c[a:b] for c in cols]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], schema=_BLOB)


#: What a pack holds, by its first byte: places of a run of documents of one task, the keys of such a run, places with document keys, sums of a run, sums by key.
_PLACES, _KEYS, _KEYED, _SUMS, _KEYED_SUMS = b"P", b"K", b"Q", b"S", b"T"


def _rows(buckets: list[int], packs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(packs, pa.binary())], schema=_BLOB)


def _dealt_run(where: np.ndarray, run: np.ndarray, keys: np.ndarray, doc: np.ndarray, cols: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """A pack for each bucket of the places of a run of documents, which are told by their number in it and whether they teach; and one pack of the documents' keys."""
    order, at_buckets, at = _split(where, cols[0])
    cols = [(2 * doc + (keys[doc] & 1))[order], *(c[order] for c in cols)]
    packs = [_PLACES + run.tobytes() + _pack([c[a:b] for c in cols]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return _rows([*at_buckets.tolist(), _of_run(run, buckets)], [*packs, _KEYS + run.tobytes() + _pack([keys])])


def _of_run(run: np.ndarray, buckets: int) -> int:
    return int(mix(run.view(U64), 8)[0] % U64(buckets))


def _dealt_keyed(where: np.ndarray, cols: list[np.ndarray], kind: bytes) -> pa.RecordBatch:
    """A pack for each bucket of rows that carry their document's key."""
    order, at_buckets, at = _split(where, cols[0])
    cols = [c[order] for c in cols]
    return _rows(at_buckets.tolist(), [kind + _pack([c[a:b] for c in cols]) for a, b in zip(at[:-1], at[1:], strict=True)])


def _packs_of(table: pa.Table, kind: bytes, run: bool) -> Iterator[tuple[np.ndarray | None, pa.Scalar]]:
    """The packs of one kind, with their run."""
    for blob in table.column("rows") if table.num_rows else []:
        raw = blob.as_py()
        if raw[:1] == kind:
            yield (np.frombuffer(raw[1:9], np.int64), pa.scalar(raw[9:])) if run else (None, pa.scalar(raw[1:]))


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of ``keys``, with their ``values`` added up."""
    if not len(keys[0]):
        return keys, values
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) for v in values]


# ------------------------------------------------------------------ unigram counts


def _of_word(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word.view(U64), 1) % U64(buckets)).astype(np.int64)


def _count_words(buckets: int):
    """Packs of (word, count) of the texts of column 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            word, count = np.unique(np.concatenate(held), return_counts=True)
            return _dealt(_of_word(word, buckets), [word, count.astype(np.int64)])

        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column(0)):
                held.append(sequence(data, offs)[0])
                n += len(held[-1])
                if n > _FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The whole counts of one bucket's words, packed; how many words and tokens they are; how many words have 2**k to 2**(k+1) - 1."""
    (word,), (n,) = _summed(*([c] for c in _unpack(table.column("rows"), 2)))
    levels = np.bincount(np.log2(np.maximum(1, n)).astype(np.int64), minlength=63)
    return pa.table({"bucket": table.column("bucket")[:1], "rows": pa.array([_pack([word, n])], pa.binary()), "words": [len(word)], "tokens": [int(n.sum())], "levels": pa.array([levels.tolist()], pa.list_(pa.int64()))})


def _frequent(counted: DataFrame, cache: int) -> Table:
    """The counts of at most ``cache`` words: of all with 2**k or more, for the least k that allows it."""
    levels = counted.select(F.posexplode("levels").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    held, least = 0, 63
    for r in sorted(levels, reverse=True):
        if held + r.n > cache:
            break
        held, least = held + r.n, r.k

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = _unpack(batch.column(0), 2)
            ok = n >= 1 << least
            yield pa.RecordBatch.from_arrays([pa.array(word[ok]), pa.array(n[ok])], names=["word", "n"])

    got = counted.select("rows").mapInArrow(reach, "word long, n long").toPandas() if held else None
    return Table(got["word"].to_numpy(np.int64).view(U64), got["n"].to_numpy(np.int64)) if held else Table(np.zeros(0, U64), np.zeros(0, np.int64))


# ------------------------------------------------------------------ places by the word before them


def _bucket_of(before: np.ndarray, second: np.ndarray, document: np.ndarray, hot: Table, buckets: int) -> np.ndarray:
    """Where a place goes: by the word before it, a hot one's also by the word before that one, a text's first token by its document."""
    at = mix(np.where(before == 0, document, before).view(U64), 2)
    salted, salts = hot.find(before)
    return ((at + np.where(salted, mix(second.view(U64), 3) % np.maximum(1, salts).astype(U64), U64(0))) % U64(buckets)).astype(np.int64)


def _emit(shared, buckets: int, depth: int, rare: bool):
    """Packs of places (document, word before, the word, earlier words): of those whose word is in the cache by the word before, or of the others by their word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, hot = shared.value
        held: list[list[np.ndarray]] = []
        keys: list[np.ndarray] = []
        n = rows = 0

        def flush() -> pa.RecordBatch:
            doc, *words = (np.concatenate(c) for c in zip(*held, strict=True))
            every = np.concatenate(keys)
            if rare:
                return _dealt_keyed(_of_word(cache.hashes(words[0]), buckets), [words[1], every[doc], words[0], *words[2:]], _KEYED)
            run = np.array([(int(every[0]) * 31 + int(every[-1]) * 7 + len(every) + TaskContext.get().partitionId()) & ((1 << 62) - 1)], np.int64)
            return _dealt_run(_bucket_of(words[1], words[2], every[doc] & ~1, hot, buckets), run, every, doc, [words[1], words[0], *words[2:]], buckets)

        for batch in batches:
            key = batch.column(0).to_numpy()
            for a, b, data, offs in text_chunks(batch.column(1)):
                h, doc = sequence(data, offs)
                ids = cache.ids(h)
                mine = (ids >= _RARE) == rare
                held.append([x[mine] for x in (doc + rows, *places(ids, doc, depth))])
                keys.append(key[a:b])
                rows += b - a
                n += int(mine.sum())
                if n > _FLUSH or rows > 200_000:
                    yield flush()
                    held, keys, n, rows = [], [], 0, 0
        if held:
            yield flush()

    return run


def _counted_places(shared, buckets: int, depth: int):
    """Places by their word, now with its count, by the word before."""

    def run(counts: pa.Table, rows: pa.Table) -> pa.Table:
        cache, hot = shared.value
        word, n = _unpack(counts.column("rows") if counts.num_rows else [], 2)
        before, document, own, *rest = _unpack((b for _, b in _packs_of(rows, _KEYED, run=False)), 2 + depth)
        _, count = Table(word, n).find(own & ~_RARE)
        return pa.Table.from_batches([_dealt_keyed(_bucket_of(before, rest[0], document & ~1, hot, buckets), [before, document, count, own, *rest], _KEYED)], schema=_BLOB)

    return run


def _hot_pairs(shared, buckets: int):
    """Packs of (hot word, next word's hash, times) by next word, of the texts of column 0, added up in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, hot = shared.value
        names = Table(cache.hashes(hot.keys), hot.keys)
        held: list[list[np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            (word, before), (times,) = _summed([np.concatenate(c) for c in zip(*held, strict=True)], [np.ones(n, np.int64)])
            return _dealt(_of_word(word, buckets), [before, word, times])

        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column(0)):
                word, before = places(*sequence(data, offs), 1)
                mine, name = names.find(before)
                held.append([word[mine].view(np.int64), name[mine]])
                n += int(mine.sum())
                if n > _FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return run


def _counted_pairs(counts: pa.Table, rows: pa.Table) -> pa.Table:
    """(hot word, pack of next word's hash, times, the next word's count): whole counts of one bucket of next words."""
    word, n = _unpack(counts.column("rows") if counts.num_rows else [], 2)
    before, own, times = _unpack(rows.column("rows") if rows.num_rows else [], 3)
    (before, own), (times,) = _summed([before, own], [times])
    count = Table(word, n).find(own)[1]
    at = np.append(np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1]))), len(before)) if len(before) else np.zeros(1, np.int64)
    packs = [_pack([own[a:b], times[a:b], count[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table({"hot": pa.array(before[at[:-1]], pa.int64()), "rows": pa.array(packs, pa.binary())})


def _first_level(shared, total: int, vocabulary: int, buckets: int):
    """The whole first level of a hot word's branch, for each bucket that its places are dealt to."""

    def run(table: pa.Table) -> pa.Table:
        cache, hot = shared.value
        before = np.array([table.column("hot")[0].as_py()], np.int64)
        own, times, count = _unpack(table.column("rows"), 3)
        order = np.argsort(own)
        own, times, count = own[order], times[order], count[order]
        states = grown(np.zeros(len(own), np.int64), times, (count + 1) / (total + vocabulary + 1))
        kept = times >= LEAST
        blob = _pack([cache.ids(own[kept].view(U64)), times[kept]])
        scalars = before.tobytes() + np.array([states.size[0], states.left[0], states.good[0]], np.float64).tobytes()
        salts = int(hot.find(before)[1][0])
        at = sorted({int((mix(before.view(U64), 2)[0] + U64(s)) % U64(buckets)) for s in range(salts)})
        return pa.table({"bucket": pa.array(at, pa.int32()), "rows": pa.array([scalars + blob] * len(at), pa.binary())})

    return run


# ------------------------------------------------------------------ growing and scoring


class States:
    """Contexts of one length: tokens seen after each, the mass left to its suffix, whether it is retained; and the probability each gives its kept next tokens."""

    def __init__(self, size, left, good, p, kept):
        self.size, self.left, self.good, self.p, self.kept = size, left, good, p, kept


def grown(of: np.ndarray, n: np.ndarray, p_suffix: np.ndarray) -> States:
    """States from their next tokens: ``of`` numbers each one's context, ``n`` is how often it was seen there, ``p_suffix`` what the suffix's state gives it."""
    many = int(of.max()) + 1 if len(of) else 0
    size = np.bincount(of, n, many)
    kept = n >= LEAST
    own = np.where(kept, n - DISCOUNT, 0.0)
    left = 1 - np.bincount(of, own, many) / np.maximum(1, size)
    p = own / size[of] + left[of] * p_suffix
    gain = np.bincount(of, np.where(kept, n * np.log(p / p_suffix), 0.0), many) + np.bincount(of, np.where(kept, 0, n), many) * np.log(np.maximum(left, 1e-300))
    return States(size, left, gain > GAIN, p, kept)


def branch(words: list[np.ndarray], teaches: np.ndarray, p_root: np.ndarray, hot: dict | None = None) -> np.ndarray:
    """The probability of each place's word in the state of its longest retained suffix. ``words``: the word, the one before it, and so on; all places of their branches are here.

    ``hot`` has the first level of words whose places are partly elsewhere: (tokens, left, retained, Table of times by next word).
    """
    p = p_root.copy()
    context = np.zeros(len(p), U64)
    at = np.arange(len(p))
    for k in range(1, len(words)):
        at = at[words[k][at] != 0]
        if not len(at):
            break
        context[at] = mix(context[at] ^ words[k][at].view(U64), 10 + k)
        _, of = np.unique(context[at], return_inverse=True)
        gram = mix(context[at] ^ mix(words[0][at].view(U64), 30), 50 + k)
        names, first, which = np.unique(gram, return_index=True, return_inverse=True)
        n = np.bincount(which, teaches[at], len(names)).astype(np.int64)
        states = grown(of[first], n, p[at][first])
        new = np.where(states.kept[which], states.p[which], states.left[of] * p[at])
        good, seen = states.good[of] & (states.size[of] > 0), states.size[of]
        if k == 1:
            for word, (size, left, retained, times) in (hot or {}).items():
                mine = words[1][at] == word
                often = times.find(words[0][at][mine])[1]
                new[mine] = np.where(often >= LEAST, (often - DISCOUNT) / max(1, size), 0.0) + left * p[at][mine]
                good[mine], seen[mine] = retained, size
        p[at] = np.where(good, new, p[at])
        # a longer context is not seen more often, and one that is seen less than LEAST times is not retained
        at = at[seen >= LEAST]
    return p


def _fixed(p: np.ndarray) -> np.ndarray:
    """-log10 in steps of 2**-32: sums of them don't depend on order, and small ones travel as few bytes."""
    return np.rint(-np.log10(p) * _STEPS).astype(np.int64)


def _own_rows(shared, total: int, vocabulary: int):
    """(doc_id, key, n_tokens, known, base) of every row: the tokens that are in the cache count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = shared.value[0]
        for batch in batches:
            for a, b, data, offs in text_chunks(batch.column(2)):
                h, doc = sequence(data, offs)
                known, count = cache.find(h)
                sums = [np.bincount(doc, minlength=b - a), np.bincount(doc, known, b - a).astype(np.int64), np.bincount(doc, np.where(known, np.log10((count + 1) / (total + vocabulary + 1)), 0.0), b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(x) for x in sums)], names=["doc_id", "key", "n_tokens", "known", "base"])

    return run


def _score(shared, total: int, vocabulary: int, buckets: int, depth: int):
    """Packs of (document, known tokens and base score of words outside the cache, score) of one bucket's places."""

    def run(rows: pa.Table, tables: pa.Table) -> pa.Table:
        hot = {}
        for blob in tables.column("rows") if tables.num_rows else []:
            raw = blob.as_py()
            size, left, good = np.frombuffer(raw[8:32], np.float64)
            own, times = _unpack([pa.scalar(raw[32:])], 2)
            hot[int(np.frombuffer(raw[:8], np.int64)[0])] = (size, left, bool(good), Table(own, times))
        runs, parts = [], []
        for name, blob in _packs_of(rows, _PLACES, run=True):
            runs.append(name)
            parts.append(_unpack([blob], 2 + depth))
        sizes = [int(p[0].max()) // 2 + 1 for p in parts]
        first = np.cumsum([0, *sizes])
        before, document, count, own, *rest = _unpack((b for _, b in _packs_of(rows, _KEYED, run=False)), 3 + depth)
        n = len(own)
        parts.append([document, before, own, *rest])
        numbers = np.repeat(first[:-1], [len(p[0]) for p in parts[:-1]]) if runs else np.zeros(0, np.int64)
        documents, before, own, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        out = [_KEYS + name.tobytes() + blob.as_py() for name, blob in _packs_of(rows, _KEYS, run=True)]
        at = [_of_run(name, buckets) for name, _ in _packs_of(rows, _KEYS, run=True)]
        if not len(own):
            return pa.Table.from_batches([_rows(at, out)], schema=_BLOB)
        m = len(own) - n
        counts = np.concatenate((shared.value[0].counts(own[:m]), count))
        root = (counts + 1) / (total + vocabulary + 1)
        p = _fixed(branch([own, before, *rest], documents & 1, root, hot))
        # places with keys come last; a run's documents are summed by their number
        which = numbers + documents[:m] // 2
        sums = np.bincount(which, p[:m], int(first[-1])).astype(np.int64)
        there = np.bincount(which, minlength=int(first[-1])) > 0
        for name, a, b in zip(runs, first[:-1], first[1:], strict=True):
            mine = np.flatnonzero(there[a:b])
            out.append(_SUMS + name.tobytes() + _pack([mine, sums[a:b][mine]]))
            at.append(_of_run(name, buckets))
        (key,), keyed = _summed([documents[m:]], [(count > 0).astype(np.int64), _fixed(root[m:]), p[m:]])
        apart = _dealt_keyed((mix(key.view(U64), 4) % U64(buckets)).astype(np.int64), [key, *keyed], _KEYED_SUMS)
        return pa.Table.from_batches([_rows(at, out), apart], schema=_BLOB)

    return run


def _by_document(table: pa.Table) -> pa.Table:
    """(key, more_known, more_base, score): sums of the runs and keys of one bucket, in fixed steps; a document may have a row of each kind."""
    keys = {int(name[0]): _unpack([blob], 1)[0] for name, blob in _packs_of(table, _KEYS, run=True)}
    sums = {name: np.zeros(len(k), np.int64) for name, k in keys.items()}
    for name, blob in _packs_of(table, _SUMS, run=True):
        doc, score = _unpack([blob], 2)
        sums[int(name[0])][doc] += score
    (key,), apart = _summed(*(lambda k, *sums: ([k], list(sums)))(*_unpack((b for _, b in _packs_of(table, _KEYED_SUMS, run=False)), 4)))
    none = np.zeros(sum(map(len, keys.values())), np.int64)
    cols = [np.concatenate(c) for c in ([*keys.values(), key], [none, apart[0]], [none, apart[1]], [*sums.values(), apart[2]])]
    return pa.table(dict(zip(("key", "more_known", "more_base", "score"), cols, strict=True)))


def score_texts(docs: DataFrame, held_out, learns, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, cache: int = CACHE, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; ``held_out`` and ``learns`` are conditions on the id column, ``depth`` (2 or more) is the longest context."""
    spark = docs.sparkSession
    jobs.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a key for each (doc_id, text); its last bit tells whether the row teaches
    teaches = F.coalesce(learns(F.col("doc_id")), F.lit(False))
    key = F.xxhash64("doc_id", "text", F.col("text").isNull()).bitwiseAND(F.lit(-2)).bitwiseOR(teaches.cast("long"))
    keyed = rows.select(key.alias("key"), "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(max(16, chars // bucket_chars))
    learned = rows.where(teaches).select("text")
    counted = jobs.cut(learned.mapInArrow(_count_words(buckets), "bucket int, rows binary").groupBy("bucket").applyInArrow(_merge, "bucket int, rows binary, words long, tokens long, levels array<bigint>"))
    sums = counted.agg(F.sum("words"), F.sum("tokens")).first()
    vocabulary, total = sums[0] or 0, sums[1] or 0
    known = _frequent(counted, cache)
    share = max(LEAST, total // buckets)
    often = known.values > share
    hot = Table(known.number[often], np.minimum(buckets, -(-known.values[often] // share)))
    shared = spark.sparkContext.broadcast((known, hot))
    counts = counted.select("bucket", "rows")
    # one place for each time that a row is there
    direct = keyed.mapInArrow(_emit(shared, buckets, depth, rare=False), "bucket int, rows binary")
    rare = keyed.mapInArrow(_emit(shared, buckets, depth, rare=True), "bucket int, rows binary")
    passed = counts.groupBy("bucket").cogroup(rare.groupBy("bucket")).applyInArrow(_counted_places(shared, buckets, depth), "bucket int, rows binary")
    pairs = learned.mapInArrow(_hot_pairs(shared, buckets), "bucket int, rows binary")
    whole = counts.groupBy("bucket").cogroup(pairs.groupBy("bucket")).applyInArrow(_counted_pairs, "hot long, rows binary")
    tables = whole.groupBy("hot").applyInArrow(_first_level(shared, total, vocabulary, buckets), "bucket int, rows binary")
    found = direct.union(passed).groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(_score(shared, total, vocabulary, buckets, depth), "bucket int, rows binary")
    by_key = found.groupBy("bucket").applyInArrow(_by_document, "key long, more_known long, more_base long, score long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("more_known", "more_base", "score")))
    own = rows.select("doc_id", key.alias("key"), "text").mapInArrow(_own_rows(shared, total, vocabulary), "doc_id long, key long, n_tokens long, known long, base double")
    times = rows.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("times"))
    return own.join(by_key.join(times, "key"), "key").select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "n_tokens", (F.col("known") + F.col("more_known") / F.col("times")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("more_base") / _STEPS / F.col("times")).alias("base_score"), (-F.col("score") / _STEPS / F.col("times")).alias("score"),
    )
