"""N-gram Jaccard join by PartEnum signatures, and the groups of near copies that it gives.

A document is the set of its distinct five-word shingles (hashed to 64 bits).
Two sets link when ``100 * |A & B| >= 75 * |A | B|``; the join finds every such
link's component exactly.

Method. Sets whose sizes lie in one band ``(r/2, r]`` are compared in one instance of the enumeration; a set of which one a third larger lies in
the next band takes part there too, so any two sets of similar enough size meet. In an instance the domain of shingles is partitioned by a hash into
``n1 = r / 4`` first-level partitions of ``n2 = 2`` second-level ones each, and of each first-level one the subsets of one second-level one are enumerated
(``k2 = 1``): a signature is the place and the whole content that a set has there. If J >= 3/4 for sets with ``a <= b`` elements, they differ in
``d <= (a + b) / 7 <= a / 3`` elements. A difference takes away one signature at most (one of the two subsets holds its part), so of a
set's signatures that are not empty at most ``d`` are not the other's: the first ``a / 3 + 1`` of them in *any* order shared by all sets are enough to share one.
Subsets of two of three parts (``n2 = 3``) would lose two signatures to a difference, and so take twice as many of them to say the same.
The shared order puts first what holds most shingles that are not common, and last what is made wholly of common ones (those that recur within a task's documents,
counted over all documents; the ``COMMON`` most frequent are told to all tasks): the more such shingles, the fewer sets share it by chance.
That only spares work: any order gives the same result. A set that has fewer signatures than that (a very small one) also emits the
first ``a / 4 + 1`` of its single shingles, of which two linked sets share one, so two such sets meet as well.

Documents that share a signature are a family. Each document has a name, the smallest hash of its shingles, and a family goes by the smallest name in it; so the
signatures of a group of near copies mostly make one family, however many they are, and a family is told as distinct (family, document) rows.
Families are dealt into blocks of ``BLOCK``. Inside a block, documents are compared by their odd cells (a bit for each of some eight cells an
element: whether the set has an odd number of elements there). Sets differ in at least as many elements as their cells, so no linked pair is
ruled out. Of the pairs left only a spanning forest leaves the block, likeliest first; those pairs' whole texts are compared exactly, and verified links make
components. A family of one block that has no other pair is done with. Then what is not in a family's largest component is held against all of the family's blocks, and now *every* pair between different components that its
cells don't rule out is compared exactly. So no link between components is missed, no two documents that are joined already are compared, and as cells
are close to the sets' own difference, few pairs are looked at in vain.

Defined cases: a null or blank text has no shingles and links with nothing; a
text with fewer than five words is one shingle; repeated rows of a doc_id are one
document; a null doc_id takes no part in linking and gets a null component.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import jobs
from plinth.llm.kernels import _P, SPACE, U64, Tokens, mix, shingle_sets, signed, text_chunks

SHINGLE = 5
#: Elements of a band's largest set to a first-level partition, and second-level partitions of one (n2); subsets of one of them are enumerated (k2 = 1).
SPREAD, PARTS = 4, 2
#: A signature's shingles that are not common count up to so many in the order.
MOST = 5
COMMON = 500_000
RECURS = 3
#: Members of a block of a family, and rows of a bucket of blocks.
BLOCK, BUCKET_ROWS = 1024, 10_000
BUCKET_CHARS, _CHUNK, _FLUSH = 10_000_000, 100_000, 800_000
_BLOB = pa.schema([("bucket", pa.int32()), ("rows", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch], id_col: int = 0, text_col: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        ids = batch.column(id_col)
        for a, b, data, offs in text_chunks(batch.column(text_col)):
            own = ids.slice(a, b - a).to_pylist()
            for d, s in shingle_sets(Tokens(data, offs, SPACE), SHINGLE):
                yield own[d], s


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, n_shingles, k1, k2) for each document, and (null, count, shingle, null) for shingles that recur in this task."""
    names = ["doc_id", "n_shingles", "k1", "k2"]
    held: list[np.ndarray] = []

    def recurring() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        h, n = h[n >= RECURS], n[n >= RECURS]
        none = pa.nulls(len(h), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(n.astype(np.int64)), pa.array(signed(h)), none], names=names)

    for batch in batches:
        rows = []
        for i, s in _sets(iter([batch])):
            rows.append((i, len(s), int(signed(np.sum(mix(s, 1), keepdims=True))[0]), int(signed(np.bitwise_xor.reduce(mix(s, 2), keepdims=True))[0])))
            held.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, names=names)
        if sum(map(len, held)) > 1_500_000:
            yield recurring()
            held = []
    if held:
        yield recurring()


def bands(n: np.ndarray) -> list[np.ndarray]:
    """Largest set size of the band that each set size lies in (a power of two), and of the next band where a set a third larger is in that one (else 0)."""
    own = np.int64(1) << np.ceil(np.log2(np.maximum(n, 4))).astype(np.int64)
    return [own, np.where(4 * n > 3 * own, 2 * own, 0)]


def signatures(sets: list[np.ndarray], common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The PartEnum signatures of sets (sorted distinct hashes), and which set each is of."""
    n = np.array([len(s) for s in sets], np.int64)
    every, cold = np.concatenate(sets), _absent(np.concatenate(sets), common)
    owner = np.repeat(np.arange(len(sets)), n)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    thin = np.zeros(len(sets), bool)
    for tops in bands(n):
        parts = np.where(tops > 0, PARTS * np.maximum(1, tops // SPREAD), 0)
        first = np.cumsum(parts) - parts
        ours = tops[owner] > 0
        of, el = owner[ours], every[ours]
        at = first[of] + (mix(el, 7) % parts[of].astype(U64)).astype(np.int64)
        part, full = np.zeros(int(parts.sum()), U64), np.zeros(int(parts.sum()), bool)
        np.add.at(part, at, mix(el, 8))
        full[at] = True
        rare = np.bincount(at, cold[ours], len(part)).astype(np.int64)
        doc = np.repeat(np.arange(len(sets)), parts)
        where = (np.arange(len(doc)) - first[doc]).astype(U64) * U64(_P) + tops[doc].astype(U64) * U64(0xC2B2AE3D27D4EB4F)
        sig, doc, rare, want = mix(part + where, 7)[full], doc[full], rare[full], n // 3 + 1
        keep = _place(rare, doc, len(sets)) < want[doc]
        out.append((sig[keep], doc[keep]))
        thin |= (tops > 0) & (np.bincount(doc, minlength=len(sets)) < want)
    if thin.any():
        mine = thin[owner]
        el, doc, rare = every[mine], owner[mine], cold[mine]
        keep = _place(rare, doc, len(sets)) < n[doc] // 4 + 1
        out.append((mix(el[keep], 5), doc[keep]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _place(rare: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Places from 0 within each document, by falling ``rare`` (up to MOST) and then as they stand; ``doc`` rises."""
    order = np.argsort(doc * (MOST + 1) + MOST - np.minimum(rare, MOST), kind="stable")
    n = np.bincount(doc, minlength=docs)
    out = np.empty(len(doc), np.int64)
    out[order] = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return out


def _absent(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.ones(len(s), dtype=bool)
    at = np.searchsorted(common, s)
    at[at == len(common)] = 0
    return common[at] != s


def _pack(*cols: np.ndarray) -> bytes:
    """Columns by byte plane: the high bytes of ids are mostly equal, which the shuffle's compression uses."""
    return np.ascontiguousarray(np.concatenate([c.view(np.uint8).reshape(len(c), -1) for c in cols], axis=1).T).tobytes()


def _unpack(blobs, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    rows = [np.ascontiguousarray(np.frombuffer(x.as_py(), np.uint8).reshape(sum(sizes), -1).T) for x in blobs]
    whole = np.concatenate(rows) if rows else np.zeros((0, sum(sizes)), np.uint8)
    ends = np.cumsum(sizes)
    return [np.ascontiguousarray(whole[:, e - n : e]).view(k).ravel() for e, n, k in zip(ends, sizes, kinds, strict=True)]


def _dealt(where: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    """A pack for each bucket."""
    return _packs(where, lambda at: _pack(*(c[at] for c in cols)))


def _packs(where: np.ndarray, pack) -> pa.RecordBatch:
    """(bucket, rows): ``pack`` of the indices of each bucket, which keep their order."""
    order = np.argsort(where, kind="stable")
    where = where[order]
    at = np.append(np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))), len(where)) if len(where) else [0]
    return pa.RecordBatch.from_arrays([pa.array(where[at[:-1]].astype(np.int32)), pa.array([pack(order[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], schema=_BLOB)


#: Bytes of a signature that travel inside its bucket; two that agree by chance only make a family larger.
_SIG = 5


def _signed_pack(sig: np.ndarray, of: np.ndarray, docs: np.ndarray, names: np.ndarray):
    """A function of indices: the pack of these signatures, each document once with the number of its own; ``of`` rises."""

    def pack(at: np.ndarray) -> bytes:
        mine = of[at]
        first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        table = _pack(docs[mine[first]], names[mine[first]], np.diff(np.append(first, len(mine))).astype(np.uint32))
        high = np.ascontiguousarray(sig[at].view(np.uint8).reshape(-1, 8)[:, 8 - _SIG :].T)
        return np.array([len(first)], np.int64).tobytes() + table + high.tobytes()

    return pack


def _signed_rows(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, document, name) of all packs of a bucket."""
    sigs, docs, names = [], [], []
    for blob in blobs:
        raw = blob.as_py()
        n = int(np.frombuffer(raw[:8], np.int64)[0])
        doc, name, times = _unpack([pa.scalar(raw[8 : 8 + 16 * n])], np.int64, np.uint32, np.uint32)
        high = np.frombuffer(raw[8 + 16 * n :], np.uint8).reshape(_SIG, -1).T
        sig = np.zeros((len(high), 8), np.uint8)
        sig[:, 8 - _SIG :] = high
        sigs.append(sig.view(U64).ravel())
        docs.append(np.repeat(doc, times))
        names.append(np.repeat(name, times))
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in ((sigs, U64), (docs, np.int64), (names, np.uint32)))


def _emit(common, buckets: int):
    """Packs of signatures by bucket, with their documents and each document's name for families: the smallest hash of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        names: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        seen: set[bytes] = set()
        held = 0

        def flush() -> pa.RecordBatch:
            sig, of = np.concatenate(sigs), np.concatenate(owners)
            order = np.argsort(of, kind="stable")
            sig, of = sig[order], of[order]
            return _packs((sig % U64(buckets)).astype(np.int64), _signed_pack(sig, of, np.concatenate(ids), np.concatenate(names)))

        def signed_up(docs: list[int], sets: list[np.ndarray]) -> None:
            sig, of = signatures(sets, common.value)
            sigs.append(sig)
            owners.append(of + sum(map(len, ids)))
            ids.append(np.array(docs, np.int64))
            starts = np.cumsum([0, *map(len, sets[:-1])])
            names.append((np.minimum.reduceat(mix(np.concatenate(sets), 21), starts) >> U64(32)).astype(np.uint32))

        docs: list[int] = []
        sets: list[np.ndarray] = []
        size = 0
        for doc, s in _sets(batches):
            if doc is None or not len(s):
                continue
            key = np.array([np.sum(mix(s, 1)), np.bitwise_xor.reduce(mix(s, 2))]).tobytes()
            if key in seen:  # an exact copy in this task: already tied to its first by the digests
                continue
            seen.add(key)
            docs.append(doc)
            sets.append(s)
            held += len(s)
            size += len(s)
            if size > _CHUNK:
                signed_up(docs, sets)
                docs, sets, size = [], [], 0
            if held > _FLUSH:
                if sets:
                    signed_up(docs, sets)
                yield flush()
                docs, sets, sigs, owners, ids, names, held, size = [], [], [], [], [], [], 0, 0
        if sets:
            signed_up(docs, sets)
        if sigs:
            yield flush()

    return run


def _distinct(family: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((doc, family))
    family, doc = family[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (family[1:] != family[:-1]) | (doc[1:] != doc[:-1])
    return family[new], doc[new]


def _repeated(buckets: int):
    """Packs of (family, document) by family: the documents of each signature of one bucket that more than one has, under the smallest of their names."""

    def run(table: pa.Table) -> pa.Table:
        sig, doc, name = _signed_rows(table.column("rows"))
        order = np.argsort(sig, kind="stable")
        sig, doc, name = sig[order], doc[order], name[order]
        at = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(at, len(sig)))
        family = np.repeat(np.minimum.reduceat(name, at), size) if len(at) else name
        many = np.repeat(size > 1, size)
        family, doc = _distinct(family[many], doc[many])
        return pa.Table.from_batches([_dealt((mix(family.astype(U64), 3) % U64(buckets)).astype(np.int64), family, doc)], schema=_BLOB)

    return run


def _families(table: pa.Table) -> pa.Table:
    """(family, doc_id) of one bucket of families, each once."""
    family, doc = _distinct(*_unpack(table.column("rows"), np.uint32, np.int64))
    return pa.table({"family": family.astype(np.int64), "doc_id": doc})


def _odd_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, cells): which cells of the domain hold an odd number of a set's elements, one bit a cell, eight cells an element or more."""
    for batch in batches:
        rows = []
        for i, s in _sets(iter([batch])):
            m = max(1024, 1 << int(8 * max(1, len(s)) - 1).bit_length())
            odd = np.bincount((mix(s, 12) & U64(m - 1)).astype(np.int64), minlength=m) & 1
            rows.append((i, np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], names=["doc_id", "cells"])


def fold(cells: np.ndarray) -> np.ndarray:
    """The odd cells of a domain of half as many cells."""
    half = cells.shape[1] // 2
    return cells[:, :half] ^ cells[:, half:]


def possible(cells: list[bytes], n: np.ndarray, ask) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, least): the pairs for which ``ask(i, j)`` holds and that may have a similarity of 0.75, with the least number of elements by which they differ.

    Two sets differ in at least as many elements as their odd cells do, so no pair with that similarity is left out.
    """
    sizes = np.array([len(c) // 8 for c in cells])
    rows = {w: np.flatnonzero(sizes == w) for w in np.unique(sizes)}
    words = {w: np.frombuffer(b"".join(cells[i] for i in at), U64).reshape(len(at), -1) for w, at in rows.items()}
    out: list[tuple[np.ndarray, ...]] = []
    for w, at in rows.items():
        # sizes of linked sets differ by a third at most, hence their domains by one step
        for other, theirs, folded in ((at, words[w], False), (rows.get(2 * w), words.get(2 * w), True)):
            if other is None:
                continue
            theirs = fold(theirs) if folded else theirs
            step = max(1, 2_000_000 // (len(other) * int(w)))
            for k in range(0, len(at), step):
                i, j = np.meshgrid(np.arange(k, min(k + step, len(at))), np.arange(len(other)), indexing="ij")
                x, y = at[i], other[j]
                ok = ask(x, y) & (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])) & (folded | (i < j))
                i, j, x, y = i[ok], j[ok], x[ok], y[ok]
                for q in range(0, len(i), max(1, 2_000_000 // int(w))):
                    part = slice(q, q + max(1, 2_000_000 // int(w)))
                    least = np.bitwise_count(words[w][i[part]] ^ theirs[j[part]]).sum(axis=1, dtype=np.int64)
                    near = 7 * least <= n[x[part]] + n[y[part]]
                    out.append((x[part][near], y[part][near], least[near]))
    i, j, least = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
    return np.minimum(i, j), np.maximum(i, j), least


def forest(i: np.ndarray, j: np.ndarray, key: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Indices of a spanning forest of the pairs by rising ``key`` over nodes that already have labels: as few pairs as join all that they all join."""
    label, order = label.copy(), np.lexsort((j, i, key))
    taken: list[np.ndarray] = []
    while True:
        order = order[label[i[order]] != label[j[order]]]
        if not len(order):
            return np.concatenate(taken) if taken else order
        # every tree takes its first pair to another one
        _, first = np.unique(np.stack((label[i[order]], label[j[order]]), axis=1).ravel(), return_index=True)
        best = order[np.unique(first // 2)]
        taken.append(best)
        root = {int(x): int(x) for x in np.unique(label)}

        def top(x: int, root=root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(label[i[best]].tolist(), label[j[best]].tolist(), strict=True):
            root[top(x)] = top(y)
        names = np.array(sorted(root))
        label = np.array([top(x) for x in names.tolist()])[np.searchsorted(names, label)]


def _near_pairs(thin: bool):
    """(a, b) of each block's members in different components that may link: all such pairs, or a forest of them, likeliest first, and (null, family) where that leaves some out."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("block", "ascending"), ("doc", "ascending")])
        family, block, doc, comp, n, home = (table.column(c).to_numpy() for c in ("family", "block", "doc", "comp", "n", "home"))
        cells = table.column("cells").to_pylist()
        at = np.append(np.flatnonzero(np.concatenate(([True], (family[1:] != family[:-1]) | (block[1:] != block[:-1])))), len(doc))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        more: set[int] = set()
        for a, b in zip(at[:-1], at[1:], strict=True):
            ids, of, size, lives = doc[a:b], comp[a:b], n[a:b], home[a:b]
            if b - a < 2 or (of == of[0]).all():
                continue
            i, j, least = possible(cells[a:b], size, lambda x, y, of=of, lives=lives: (of[x] != of[y]) & (lives[x] | lives[y]))  # noqa: B023
            if thin:
                ok = forest(i, j, least / (size[i] + size[j]), np.unique(of, return_inverse=True)[1])
                if len(ok) < len(i):
                    more.add(int(family[a]))
                i, j = i[ok], j[ok]
            out.append((ids[i], ids[j]))
        x, y = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 2
        found = pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})
        return pa.concat_tables([found, pa.table({"a": pa.nulls(len(more), pa.int64()), "b": pa.array(sorted(more), pa.int64())})])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, None)
    for batch in batches:
        a_ids, left, ok = batch.column(0), batch.column(2), []
        for i, (_, b) in enumerate(_sets(iter([batch]), 1, 3)):
            if a_ids[i].as_py() != last[0]:
                last = (a_ids[i].as_py(), next(_sets(iter([pa.RecordBatch.from_arrays([a_ids.slice(i, 1), left.slice(i, 1)], names=["a", "t"])])))[1])
            a = last[1]
            both = len(np.intersect1d(a, b, assume_unique=True))
            ok.append(100 * both >= 75 * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ok, pa.bool_())], names=["a", "b", "linked"])


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, linked): ``pairs`` (a, b) of document ids, and whether their whole texts' shingle sets have a similarity of 0.75 or more."""
    ids = jobs.cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    # dealt by doc_id once: both joins read that one exchange, and texts are neither stored nor dealt again
    texts = jobs.semi(docs, ids, "doc_id").dropDuplicates(["doc_id"])
    a, b = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"{x}_text")) for x in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "a_text", "b_text").mapInArrow(_verify, "a long, b long, linked boolean")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: its set's size and the smallest doc_id reachable by links."""
    jobs.small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    read = jobs.cut(docs.mapInArrow(_digest, "doc_id long, n_shingles long, k1 long, k2 long"))
    digest = read.where("k2 is not null")
    recurring = read.where("k2 is null").groupBy("k1").agg(F.sum("n_shingles").alias("n")).orderBy(F.desc("n"), "k1").limit(COMMON)
    common = np.sort(recurring.select("k1").toPandas()["k1"].to_numpy(np.int64).view(U64))
    # one representative for each distinct set
    firsts = jobs.cut(digest.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep")))
    reps = jobs.cut(digest.join(firsts, ["n_shingles", "k1", "k2"]).select("doc_id", "rep", "n_shingles").distinct())
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(max(16, chars // BUCKET_CHARS))
    blobs = docs.mapInArrow(_emit(docs.sparkSession.sparkContext.broadcast(common), buckets), "bucket int, rows binary")
    shared = blobs.groupBy("bucket").applyInArrow(_repeated(buckets), "bucket int, rows binary").groupBy("bucket").applyInArrow(_families, "family long, doc_id long")
    members = jobs.store(shared.join(reps, "doc_id").select("family", F.col("rep").alias("doc"), F.col("n_shingles").alias("n")).distinct())
    comps = jobs.components(_links(docs, members)).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    # copies of one set, and sets that link, share their smallest doc_id
    own = reps.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    by_doc = own.join(comps, "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("component_id"))
    return digest.select("doc_id", "n_shingles").join(by_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Verified links (a, b) that join every component; ``members`` (family, doc, n) are the sets that share a signature."""
    spark = docs.sparkSession
    ids = jobs.cut(members.select(F.col("doc").alias("doc_id")).distinct())
    cells = jobs.store(jobs.semi(docs, ids, "doc_id").mapInArrow(_odd_cells, "doc_id long, cells binary").dropDuplicates(["doc_id"])).withColumnRenamed("doc_id", "doc")
    sizes = jobs.cut(members.groupBy("family").agg(F.min("doc").alias("hub"), F.count("*").alias("size")).where("size > 1").select("family", "hub", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    rows = jobs.store(members.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")))
    every, seen = F.sequence(F.lit(0), F.col("blocks") - 1), spark.createDataFrame([], "a long, b long, linked boolean")

    def looked_at(dealt: DataFrame, thin: bool) -> tuple[DataFrame, DataFrame]:
        """``seen`` and the pairs of each family's blocks that may link, and the families of which there are more; ``dealt`` is (family, doc, n, comp, own, block)."""
        full = dealt.withColumn("home", F.col("own") == F.col("block")).join(cells, "doc")
        buckets = int(max(jobs.partitions(spark), dealt.count() // BUCKET_ROWS))
        found = full.select("family", "block", "doc", "comp", "n", "home", "cells").groupBy(F.pmod(F.xxhash64("family", "block"), F.lit(buckets)).alias("bucket")).applyInArrow(_near_pairs(thin), "a long, b long")
        pairs = jobs.cut(found.distinct().join(seen, ["a", "b"], "left_anti"))
        return jobs.cut(seen.union(verified(docs, pairs.where("a is not null")))), pairs.where("a is null").select(F.col("b").alias("family"))

    def apart(rows: DataFrame) -> DataFrame:
        """The members of families that are in several components, those of the largest in their own block, the others in all."""
        comps = jobs.components(seen.where("linked")).select(F.col("node").alias("doc"), F.col("component").alias("comp"))
        now = jobs.store(rows.join(comps, "doc", "left").withColumn("comp", F.coalesce("comp", "doc")))
        main = jobs.cut(now.groupBy("family", "comp").count().groupBy("family").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k"))
        return now.join(main, "family").withColumn("block", F.explode(F.when(F.col("comp") == F.col("main"), F.array("own")).otherwise(every))).drop("main")

    # inside blocks, which all hold the family's first; then what is apart in families of several blocks; each time only what may join most
    seen, more = looked_at(rows.withColumn("comp", F.col("doc")).withColumn("block", F.explode(F.when(F.col("doc") == F.col("hub"), every).otherwise(F.array("own")))), thin=True)
    wide = rows.where("blocks > 1")
    if wide.limit(1).count():
        seen, _ = looked_at(apart(wide), thin=True)
    # every pair between different components that may link and has not been looked at; of a family of one block that had no more than the forest, all were
    seen, _ = looked_at(apart(wide.union(jobs.semi(rows.where("blocks = 1"), more, "family"))), thin=False)
    return seen.where("linked").select("a", "b")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those of which a near copy with a smaller id is there (rows without an id stay)."""
    drop = jobs.cut(near_copies(docs, id_col, text_col).where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct())
    return jobs.anti(docs, drop, id_col)
