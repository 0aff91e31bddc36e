"""Spelling variants against plain Python, and the hashes by themselves."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plinth.llm import spelling
from plinth.llm.kernels import text_chunks
from tests.llm.test_operators import frame, odd


def counted(docs):
    n = Counter()
    for doc_id, text in docs:
        if doc_id is None:
            continue
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_force(n):
    form, near = {}, {}
    for w in n:
        others = [o for o in n if one_edit(w, o)]
        near[w] = len(others)
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return out


def typo(rng, w):
    i, kind = rng.randrange(len(w)), rng.randrange(3)
    return w[:i] + rng.choice("abcàÿ") * (kind > 0) + w[i + (kind != 1) :]


@pytest.mark.parametrize("bucket", [200_000, 50])
def test_variants_agree_with_plain_python(spark, monkeypatch, bucket):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    rng = random.Random(12)
    base = ["".join(rng.choice("aabcdeÀéÿ") for _ in range(rng.randrange(5, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaab", "baaaaaa"]
    pool = [(w, 400 // (1 + k % 9)) for k, w in enumerate(base)]
    pool += [(typo(rng, w), rng.choice([1, 5, 6, 30])) for w, _ in pool for _ in range(4)]
    pool += [(typo(rng, w), rng.choice([5, 6])) for w, _ in pool]
    pool += [("lantern", 400), ("lanterm", 60), ("lamterm", 10)]
    every = [w if rng.random() < 0.8 else w.upper() for w, c in pool for _ in range(c)]
    rng.shuffle(every)
    docs = [(i - 5, rng.choice([" ", "-", "1", " €", "×"]).join(every[a : a + 40])) for i, a in enumerate(range(0, len(every), 40))]
    docs += [(None, "neverland " * 9), (9000, None), (9001, "")]
    want = counted(docs)
    got = [tuple(r) for r in spelling.spelling_variants(frame(spark, docs, clash=True).repartition(3)).collect()]
    assert len(got) == len(want) and set(got) == by_force(want)
    assert len({r[2] for r in got}) < len(got) and any(r[1] and r[1] != r[2] for r in got)


def test_every_hash_can_collide(spark, monkeypatch):
    """With all keys under a few values only the strings decide."""
    n = {"kitten": 100, "kittens": 9, "sitten": 8, "mitten": 300, "bitter": 7, "puzzle": 5, "puzzles": 5}
    rows = []
    words = list(n)
    points, first = spelling._letters(pa.array(words))
    for i, w in enumerate(words):
        rows += [{"key": 1, "place": -1, "word": w, "n": n[w]}] + [{"key": 1 + p % 2, "place": p, "word": w, "n": n[w]} for p in range(len(w))]
    rows = [r | {"key": 1} for r in rows]
    got = Counter()
    for r in spelling._meet(pa.Table.from_pylist(rows)).to_pylist():
        got[r["word"]] += r["near"]
    assert got == Counter({w: sum(one_edit(w, o) for o in n) for w in n if any(one_edit(w, o) for o in n)})
    assert len(first) == len(words) + 1 and len(points) == sum(map(len, words))


def test_deletion_keys_are_those_of_the_shorter_words():
    rng = random.Random(2)
    words = ["".join(rng.choice("abÿ€𝄞") for _ in range(rng.randrange(1, 20))) for _ in range(200)]
    whole, without = spelling.deletion_keys(*spelling._letters(pa.array(words)))
    shorter = [w[:i] + w[i + 1 :] for w in words for i in range(len(w))]
    keys, _ = spelling.deletion_keys(*spelling._letters(pa.array(shorter)))
    assert (keys == without).all() and len(set(whole.tolist())) == len(set(words))


def test_crc32_of_slices():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + rng.integers(0, 900, 300)
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(300)], np.uint32)
    got = spelling.crc32(data, start, end, before)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(start, end, before, strict=True)]


def test_runs_are_those_of_the_pattern():
    texts = ["Ünder-Über Straße×x", "a€b²c", "ÿ", None, "ĀbcÀ" * 3]
    _, _, data, offs = next(text_chunks(pa.array(texts)))
    t = spelling._runs(data, offs)
    got = [(int(d), bytes(t.data[a:b]).decode()) for d, a, b in zip(t.doc, t.start, t.end, strict=True)]
    assert got == [(i, re.sub("[A-Z]", lambda m: m[0].lower(), r)) for i, x in enumerate(texts) for r in re.findall("[A-Za-zÀ-ÿ]+", x or "")]


def test_odd_rows(spark):
    rows = spelling.spelling_variants(odd(spark, random.Random(1)).unionByName(frame(spark, [(8, "letters " * 6 + "l" * 700_000)]), allowMissingColumns=True)).collect()
    assert [(r.word, r.form, r.root, r.n_near, r.form_n) for r in rows] == [("letters", None, "letters", 0, None)]
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
