"""Ranked search against plain Python, and its parts by themselves."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from plinth.llm import ranked_search as rs
from tests.llm.test_operators import frame, odd

PATTERN = re.compile(rs._PATTERN)


def terms(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_force(docs, items, k=rs.K):
    bags = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in set(items):
        if i is not None and t is not None:
            asked[i] = asked.get(i, Counter()) + Counter(terms(t))
    out = set()
    for i, q in asked.items():
        scored = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, c in q.items() if t in b)
            if s > 0:
                scored.append((-s, d))
        out |= {(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])}
    return out


def texts(rng, n, vocabulary=400):
    return [" ".join(rng.choice(["Wort-", "straße ", "a", ""]) + f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize(("shard", "window", "block"), [(16 << 20, 4096, 256), (3000, 7, 3), (1, 1, 1)])
def test_ranks_agree_with_plain_python(spark, monkeypatch, shard, window, block):
    monkeypatch.setattr(rs, "WINDOW", window)
    monkeypatch.setattr(rs, "BLOCK", block)
    rng = random.Random(17)
    docs = [(i * 37 % 401 - 50, t) for i, t in enumerate(texts(rng, 300))]
    hot = "the passage that very many of the documents share whole"
    docs += [(1000 + i, hot) for i in range(120)] + [(2000, None), (2001, ""), (2002, "!!"), (None, hot)]
    items = list(enumerate(texts(rng, 12))) + [(50, hot), (51, None), (52, ""), (53, "no such words"), (54, "w1"), (54, "w1"), (None, "w1")]
    frame_of = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, docs, clash=True).repartition(3)
    # tasks read the sizes from their own copy of the module
    old = rs._index.__defaults__
    index = rs.build_index(df) if shard == 16 << 20 else _small_index(spark, df, shard)
    assert rs._index.__defaults__ == old
    got = [tuple(r) for r in rs.search(index, frame_of).collect()]
    assert len(got) == len(set(got)) and set(got) == by_force(docs, items)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == 50] == list(range(1000, 1020))


def _small_index(spark, df, size):
    def run(batches):
        rs.SHARD_BYTES = size
        yield from rs._index(batches)

    return rs.jobs.cut(df.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, rs._INDEX))


def test_bytes_of_seven_bits_keep_every_number():
    rng = np.random.default_rng(2)
    v = np.concatenate(([0, 1, 127, 128, 16383, 16384, 2**40, 2**62], rng.integers(0, 1 << 50, 1000)))
    data, size = rs.pack(v)
    assert size.sum() == len(data) and (rs.unpack(data.tobytes()) == v).all() and len(rs.unpack(b"")) == 0


def test_the_heap_is_bounded_and_exact():
    rng = np.random.default_rng(5)
    ids = np.sort(rng.choice(10**6, 9000, replace=False))
    m = np.full(9000, 100)
    cursors, want = [], np.zeros(9000, np.int64)
    for w in (3, 50, 400, 400):
        doc = np.sort(rng.choice(9000, 9000 // (1 + w // 10), replace=False))
        tf = rng.integers(1, 4, len(doc))
        data, _ = rs.pack(np.stack((np.diff(doc, prepend=0), tf), axis=1).ravel())
        cursors.append((rs._Cursor(data.tobytes(), w, m), 2))
        np.add.at(want, doc, 2 * w * (10**9 * tf // (1000 * tf + 1200)))
    got = sorted(((s, -d) for s, d in rs.best(cursors, ids, 20)), key=lambda x: (-x[0], x[1]))
    order = np.lexsort((ids, -want))[:20]
    assert got == [(int(want[i]), int(ids[i])) for i in order]


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "tiny W7 w8"), (1, "tiny W7 w8")], "item_id long, text string")
    got = rs.search(rs.build_index(odd(spark, random.Random(1))), items).collect()
    assert [r.doc_id for r in got if r.doc_id in (4,)] == [4, 4] and [r.rank for r in sorted(got, key=lambda r: r.rank)] == list(range(1, len(got) + 1))
    assert rs.search(rs.build_index(frame(spark, [])), items).count() == 0
    assert rs.search(rs.build_index(frame(spark, [(1, "tiny")])), items.limit(0)).count() == 0


def test_a_text_longer_than_a_shard(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(130_000))
    docs = [(1, long), (2, "w1 w2 w3"), (3, long[:50_000]), (4, None)]
    items = [(7, "w1 w2"), (8, long)]
    index = _small_index(spark, frame(spark, docs, clash=True).repartition(1), 1000)
    got = {tuple(r) for r in rs.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(long) > 600_000 and got == by_force(docs, items)
