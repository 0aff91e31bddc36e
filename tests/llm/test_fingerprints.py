"""Consistent weighted samples against plain Python, and their collision rate against the generalised Jaccard similarity."""

import hashlib
import math
import random
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from plinth.llm import fingerprints as fp
from plinth.llm.queries import QUERIES
from tests.llm.test_operators import frame, odd, plain, words


def hashed(*values):
    """Hash of a row of longs, strings or nulls: each seeds the next one."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(data, seed)
            seed -= (seed >> 63) << 64
            seed &= 0xFFFFFFFFFFFFFFFF
    return seed - ((seed >> 63) << 64)


def level(h, w, i):
    x, y = (v & 0xFFFFFFFFFFFFFFFF for v in (hashed(h, (i,)), hashed(h, (i,), (i,))))
    low = ((x >> 12) + 0.5) * 2.0**-52
    f, g, e = -math.log1p(-low), -math.log(((y >> 32) + 0.5) * 2.0**-32), -math.log(((y & 0xFFFFFFFF) + 0.5) * 2.0**-32)
    r = math.log((f + g) / f) + e
    t = math.floor((math.log(w) + e) / r)
    return low if w == 1 or t == 0 else -math.expm1(-f * math.exp(-r * t))


def samples(text):
    h = [hashed(w) for w in plain(text.lower())]
    bag = Counter(hashed(*h[max(0, i - fp.SHINGLE + 1) : i + 1]) for i in range(len(h)))
    return [min(level(t, w, i) for t, w in bag.items()) if bag else None for i in range(fp.SAMPLES)]


def alike(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / fp.SAMPLES


def test_fingerprints_agree_with_plain_python(spark):
    rng = random.Random(3)
    texts = []
    for i in range(40):
        w = words(rng, rng.randrange(1, 60), 300)
        texts.append((i * 7 % 41, " ".join(w * (1 + i % 3)) + (" Größe ÄÖ" if i % 4 == 0 else "")))
    texts += [(100, None), (101, ""), (102, texts[5][1])]
    got = {r.doc_id: r for r in fp.fingerprints(frame(spark, texts)).collect()}
    order = sorted(texts, reverse=True)
    assert len(got) == len(texts)
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n, half = len(text), len(text) // 2
        edited = text[: n - half] + after[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        own = samples(text)
        assert r.near_edited == pytest.approx(alike(own, samples(edited)), abs=0.017)
        assert r.near_next == pytest.approx(alike(own, samples(after)), abs=0.017)
    assert got[102].fingerprint == got[texts[5][0]].fingerprint and got[100].fingerprint == got[101].fingerprint == "0000" * fp.SAMPLES
    assert len({r.fingerprint for r in got.values()}) == len({t or "" for _, t in texts})


def test_collisions_are_the_weighted_jaccard_similarity(spark):
    """Weights that are no whole numbers; 60 pairs of 64 samples."""
    rng = random.Random(8)
    rows, want = [], 0.0
    for k in range(60):
        terms = [(rng.getrandbits(60), rng.choice([1.0, 0.3, 1.7, 4.0]), rng.choice([1.0, 0.3, 1.9, 5.5])) for _ in range(50)]
        want += sum(min(a, b) for _, a, b in terms) / sum(max(a, b) for _, a, b in terms) / 60
        rows += [(k, 0, [(h, a) for h, a, _ in terms]), (k, 1, [(h, b) for h, _, b in terms])]
    df = spark.createDataFrame(rows, "k long, side int, terms array<struct<h:long,w:double>>")
    s = fp.minima(df, ["k", "side"], "terms")
    pairs = s.where("side = 0").alias("a").join(s.where("side = 1").alias("b"), F.col("a.k") == F.col("b.k"))
    got = pairs.agg(F.avg(fp.likeness(F.col("a.samples"), F.col("b.samples")))).first()[0]
    assert abs(got - want) < 4 * math.sqrt(want * (1 - want) / (60 * fp.SAMPLES))


def test_ranges_do_not_change_the_neighbours(spark, monkeypatch):
    rng = random.Random(4)
    df = frame(spark, [(i * i, " ".join(words(rng, 12))) for i in range(60)])
    one = {r.doc_id: tuple(r) for r in fp.fingerprints(df).collect()}
    monkeypatch.setattr(fp, "RANGES_A_TASK", 1)
    assert {r.doc_id: tuple(r) for r in fp.fingerprints(df.repartition(7)).collect()} == one


def test_odd_rows(spark):
    rows = fp.fingerprints(odd(spark, random.Random(1))).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 4, 5, 6] and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[5].fingerprint == by[6].fingerprint and by[6].near_next == 1.0 and by[1].n_chars == 0 and by[3].n_chars == 4
    # of two equal rows of one doc_id the first is followed by the second
    assert sorted(r.near_next for r in rows if r.doc_id == 4) == [0.0, 1.0]
    one = fp.fingerprints(frame(spark, [(9, "alone in the table")])).first()
    assert one.near_next == 1.0
    assert fp.fingerprints(frame(spark, [])).count() == 0


def test_likeness_tells_edited_texts_from_others(spark):
    rows = QUERIES["op11_document_fingerprints"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)
    mean = sum(r.near_edited for r in rows) / len(rows)
    assert 0.28 < mean < 0.42


def test_a_text_longer_than_a_chunk(spark):
    rng = random.Random(5)
    long = " ".join(words(rng, 120_000))
    got = {r.doc_id: r for r in fp.fingerprints(frame(spark, [(1, long), (2, long + " end"), (3, "short one")])).collect()}
    assert got[1].n_chars == len(long) > 600_000 and got[2].near_next > 0.9
    for i, before, after in ((1, long, "short one"), (3, "short one", long + " end")):
        half = len(before) // 2
        assert got[i].edited_sha256 == hashlib.sha256((before[: len(before) - half] + after[:half]).encode()).hexdigest()
