"""Each operator against brute force on small tables, and on rows that are odd in every way."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinth.llm import ann, decontaminate, kernels, license_scan, line_dedup, ngram_join, packing, quality, substring_dedup, suffix_dedup, suffix_tree_lm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, ties, repeated rows, a very long text.
ODD = [(None, "x y z", None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "Tiny.", "en", "a", 5), (4, "Tiny.", "en", "a", 5), (None, None, None, None, None)]


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, rows, clash=False):
    df = spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("copy", "rank", "pos", "start", "h", "w", "id", "n", "bucket", "fp")}) if clash else df


def odd(spark, rng):
    long = " ".join(words(rng, 30_000))
    return frame(spark, [*ODD, (5, long), (6, long)], clash=True)


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---------------------------------------------------------------- kernels


def test_tokens_and_hashes_are_the_same_in_every_chunk():
    import pyarrow as pa

    texts = ["One two\tthree", None, "", "two", "zwölf Two one", "x" * 50]
    seen = defaultdict(set)
    for size in (1, 7, 10_000):
        for a, _, data, offs in kernels.text_chunks(pa.array(texts), size):
            t = kernels.Tokens(data, offs, kernels.SPACE)
            for d, s, e, h in zip(t.doc, t.start, t.end, t.hashes(), strict=True):
                seen[bytes(t.data[s:e]).decode()].add(int(h))
                assert bytes(t.data[s:e]).decode() in plain(texts[a + d])
    assert set(seen) == {"one", "two", "three", "zwölf", "x" * 50} and all(len(v) == 1 for v in seen.values())
    assert len({next(iter(v)) for v in seen.values()}) == 5


# ---------------------------------------------------------------- op1


def span_oracle(docs):
    """Sentences removed, by definition."""
    seen, gone = {}, defaultdict(set)
    for doc, text in sorted(docs):
        sent, cur = [], []
        for line in text.split("\n"):
            for w in plain(line):
                cur.append(w)
                if w[-1] in ".!?":
                    sent.append(cur)
                    cur = []
            if cur:
                sent.append(cur)
                cur = []
        for s in range(len(sent)):
            e = min(s + substring_dedup.RUN, len(sent))
            for k in range(substring_dedup.RUN - 1, 0, -1):
                if s + k <= len(sent) and sum(map(len, sent[s : s + k])) >= substring_dedup.LONG:
                    e = s + k
            n = sum(map(len, sent[s:e]))
            if n < substring_dedup.LEAST or not (e - s == substring_dedup.RUN or n >= substring_dedup.LONG or (s == 0 and e == len(sent))):
                continue
            run = tuple(w for x in sent[s:e] for w in x)
            if run in seen:
                gone[doc] |= set(range(s, e))
            else:
                seen[run] = (doc, s)
    return {d: len(g) for d, g in gone.items()}


def test_spans_agree_with_brute_force(spark):
    rng = random.Random(1)
    pool = [" ".join(words(rng, rng.randrange(1, 45))) + rng.choice([".", "!", "", "?"]) for _ in range(60)]
    docs = [(i, rng.choice([" ", "\n"]).join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(80)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_spans(frame(spark, docs).repartition(5)).collect()}
    assert got == span_oracle(docs)


def test_spans_remove_the_later_passage_only(spark):
    rng = random.Random(2)
    passage = ". ".join(" ".join(words(rng, 12)) for _ in range(5)) + "."
    docs = [(1, "Before it. " + passage + " After one."), (2, "Something else here. " + passage), (3, " ".join(words(rng, 80)))]
    got = substring_dedup.dedup_spans(frame(spark, docs)).collect()
    assert [(r.doc_id, r.text.strip()) for r in got] == [(2, "Something else here.")]


def test_spans_remove_three_sentences_whatever_their_length(spark):
    rng = random.Random(15)
    passage = " ".join(" ".join(words(rng, n)) + "." for n in (38, 5, 30))
    fill = lambda: " ".join(words(rng, 9)) + "."
    docs = [(1, f"{fill()} {passage} {fill()}"), (2, f"Something else here. {passage} Its own end."), (3, f"{fill()} {fill()}")]
    got = substring_dedup.dedup_spans(frame(spark, docs)).collect()
    assert [(r.doc_id, r.n_removed, r.text.split()) for r in got] == [(2, 3, "Something else here. Its own end.".split())]


def test_spans_agree_with_all_runs(spark):
    rng = random.Random(16)
    pool = [" ".join(words(rng, rng.randrange(1, 45))) + "." for _ in range(12)]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    seen, want = set(), defaultdict(set)
    for doc, text in docs:
        sent = [x.split() for x in re.findall(r"[^.]+\.", text)]
        for s in range(len(sent)):
            size = lambda e: sum(map(len, sent[s:e]))
            ends = {e for e in range(s + 1, len(sent) + 1) if e - s <= substring_dedup.RUN and size(e) >= substring_dedup.LONG}
            ends = {*list(sorted(ends))[:1], min(s + substring_dedup.RUN, len(sent))}
            for e in ends:
                run = tuple(w for x in sent[s:e] for w in x)
                if len(run) < substring_dedup.LEAST or not (e - s == substring_dedup.RUN or len(run) >= substring_dedup.LONG or (s, e) == (0, len(sent))):
                    continue
                if run in seen:
                    want[doc] |= set(range(s, e))
                seen.add(run)
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_spans(frame(spark, docs).repartition(5)).collect()}
    assert got == {d: len(g) for d, g in want.items()}


# ---------------------------------------------------------------- op2


@pytest.mark.parametrize(("text", "labels"), [
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"), ("This work is licensed under the terms of the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Released under the MIT License", "mit,mit-notice"), ("Released under the fine MIT License", "mit"), ("licensed under CC BY-NC 4.0", "cc-by-nc-4.0"), ("licensed under CC BY 4.0", ""), ("released under the mit", ""), (None, ""),
])
def test_templates(spark, text, labels):
    r = license_scan.scan_licenses(frame(spark, [(1, text)])).first()
    assert r.labels == labels and r.score == (1.0 if "-" in labels else 0.5 if labels else 0.0)


def spelt(markup, rng):
    """A text that the markup allows, with every choice drawn."""

    def of(parts):
        for p in parts:
            if isinstance(p, list):
                if rng.random() < 0.5:
                    yield from of(p)
            elif isinstance(p, tuple):
                yield from (f"any{rng.randrange(99)}" for _ in range(rng.randint(*p)))
            else:
                yield p

    return list(of(license_scan.parse(markup)))


def test_whole_licenses_need_every_mandatory_word(spark):
    rng = random.Random(17)
    docs, want = [], {}
    for label, markup in license_scan.TEMPLATES.items():
        mandatory = {w for w in license_scan.parse(markup) if isinstance(w, str)}
        for _ in range(6):
            text = spelt(markup, rng)
            docs.append((len(docs), "Foreword. " + ", ".join(text).upper() + "\nAfterword."))
            want[len(docs) - 1] = (label, True)
            at = rng.choice([i for i, w in enumerate(text) if w in mandatory])
            docs.append((len(docs), " ".join(["Foreword.", *text[:at], "changed", *text[at + 1 :], "Afterword."])))
            want[len(docs) - 1] = (label, False)
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan_licenses(frame(spark, docs)).collect()}
    for i, (label, there) in want.items():
        # a word that also stands in an optional place may be changed without harm only where the rest still matches
        hit = re.search(f"(?:^| ){license_scan.regex(license_scan.TEMPLATES[label])}", "".join(f"{w} " for w in re.findall(r"[a-z0-9]+", docs[i][1].lower())))
        assert (label in got[i]) == bool(hit) and (bool(hit) or not there), (label, docs[i])
    assert sum(label not in got[i] for i, (label, there) in want.items() if not there) > 60


def test_automata_agree_with_regular_expressions(spark):
    rng = random.Random(3)
    markup = "a [[b [[c]]]] {{1..2}} d [[{{0..1}} e]]"
    for_label = license_scan.Scanner({"x": markup}, {"a b": "ab"})
    docs = [(i, " ".join(rng.choice("abcdez") for _ in range(rng.randrange(0, 9)))) for i in range(400)]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(frame(spark, docs), {"x": markup}, {"a b": "ab"}).collect()}
    for i, text in docs:
        base = any(text.split()[k : k + 2] == ["a", "b"] for k in range(8))
        hit = re.search(f"(?:^| ){license_scan.regex(markup)}", "".join(w + " " for w in text.split()))
        assert got[i] == ",".join(["ab"] * base + ["x"] * bool(hit)), text
    assert for_label.automata["x"].accepts.any()


# ---------------------------------------------------------------- op3


def test_quality_learns_from_labels_that_are_not_held_out(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        docs.append((i, " ".join(w + rng.choice(["!!", "###"]) if bad else w for w in words(rng, 40)) + "."))
        labels.append((i, 0 if bad else 1, 0))
    got = quality.quality_scores(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == (r.doc_id % 4 != 0) == (r.score >= 0.3) for r in got if r.held_out)
    kept = quality.keep_good(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r.doc_id for r in kept.collect()} == {i for i in range(400) if i % 4}


# ---------------------------------------------------------------- op4


def test_classifier_ranks_labels_that_it_has_not_seen(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels.where("quality is not null"), "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 40 and len(bad) > 5
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9


def test_lm_base_is_exact_and_contexts_help(spark):
    rng = random.Random(5)
    base = [words(rng, 60, 200) for _ in range(12)]
    docs = [(i, " ".join(rng.choice(base))) for i in range(300)] + [(400, None), (401, ""), (402, "never seen words")]
    part = lambda d: F.crc32(d.cast("string")) % 7
    got = {r.doc_id: r for r in suffix_tree_lm.score_texts(frame(spark, docs).repartition(5), lambda d: part(d) == 2, lambda d: part(d) != 2).collect()}
    count = Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*plain(t), None])
    total, kinds = sum(count.values()), len(count)
    for i, t in docs:
        tokens = [*plain(t), None]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[w] > 0 for w in tokens), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in tokens), rel_tol=1e-9)
    assert all(got[i].score > got[i].base_score for i in range(300) if got[i].held_out)


def tree_by_force(texts, depth):
    """A function of (context, word): log10 of the word's probability in the state of the context's longest retained suffix."""
    lm, count, after = suffix_tree_lm, Counter(), defaultdict(Counter)
    for t in texts:
        tokens = [*plain(t), None]
        count.update(tokens)
        for i, w in enumerate(tokens):
            for k in range(1, min(depth, i) + 1):
                after[tuple(tokens[i - k : i])][w] += 1
    total, kinds = sum(count.values()), len(count)
    states = {}

    def p(context, w):
        while context and context not in states:
            context = context[1:]
        if not context:
            return (count[w] + 1) / (total + kinds + 1)
        own, left, size = states[context]
        return (own[w] - lm.DISCOUNT) / size * (w in own) + left * p(context[1:], w)

    for c in sorted(after, key=len):
        size = sum(after[c].values())
        own = {w: n for w, n in after[c].items() if n >= lm.LEAST}
        left = 1 - sum(n - lm.DISCOUNT for n in own.values()) / size
        new = {w: (n - lm.DISCOUNT) / size + left * p(c[1:], w) for w, n in own.items()}
        gain = sum(n * math.log(new[w] / p(c[1:], w)) for w, n in own.items()) + (size - sum(own.values())) * math.log(max(left, 1e-300))
        if gain > lm.GAIN:
            states[c] = (Counter(own), left, size)
    return p, states, count


@pytest.mark.parametrize(("depth", "cache", "chars"), [(3, 1_000_000, 5_000_000), (2, 20, 300), (4, 0, 1000)])
def test_lm_scores_agree_with_a_tree_by_force(spark, depth, cache, chars):
    rng = random.Random(31)
    phrases = [words(rng, rng.randrange(2, 7), 40) for _ in range(15)]
    docs = [(i, " ".join(w for _ in range(rng.randrange(1, 12)) for w in (["the"] if rng.random() < 0.5 else rng.choice(phrases)))) for i in range(150)] + [(200, "never seen words"), (201, None), (7, docs_again := "again and again"), (7, docs_again)]
    part = lambda d: F.crc32(d.cast("string")) % 7
    rows = suffix_tree_lm.score_texts(frame(spark, docs).repartition(5), lambda d: part(d) == 2, lambda d: part(d) != 2, depth=depth, cache=cache, bucket_chars=chars).collect()
    p, states, _ = tree_by_force([t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2], depth)
    assert max(map(len, states)) == min(depth, 3)
    assert len(rows) == len(docs)
    got = {r.doc_id: r.score for r in rows if r.doc_id != 7} | {(7, t): min(r.score for r in rows if r.doc_id == 7 and r.n_tokens == len(plain(t)) + 1) for i, t in docs if i == 7}
    for i, t in docs:
        tokens = [*plain(t), None]
        want = sum(math.log10(p(tuple(tokens[max(0, k - depth) : k]), w)) for k, w in enumerate(tokens))
        assert math.isclose(got[i if i != 7 else (7, t)], want, rel_tol=1e-9), (i, t)
    everything = {w for t in docs for w in plain(t[1])} | {None, "unknown"}
    for c in list(states)[:40]:
        assert math.isclose(sum(p(c, w) for w in everything), 1, rel_tol=1e-2)  # by force: words outside training share the rest


def test_lm_states_sum_to_one():
    rng = np.random.default_rng(3)
    seen = rng.choice(np.array([11, 13, 17, 19, 23], np.uint64), 3000, p=[0.4, 0.3, 0.15, 0.1, 0.05])
    doc = np.zeros(len(seen), np.int64)
    vocabulary, count = np.unique(seen, return_counts=True)
    every = np.append(vocabulary, np.uint64(999))  # one more for all words that were not seen
    root = np.append((count + 1) / (len(seen) + len(vocabulary) + 1), 1 / (len(seen) + len(vocabulary) + 1))
    contexts = [(a, b) for a in vocabulary for b in vocabulary]
    ask = [np.array([w for _ in contexts for w in every]), np.array([b for _, b in contexts for _ in every]), np.array([a for a, _ in contexts for _ in every])]
    learned = suffix_tree_lm.places(seen, doc, 2)
    ask = [x.astype(np.int64) for x in ask]
    learned = [x.astype(np.int64) for x in learned]
    p_root = np.concatenate([root[np.searchsorted(every.astype(np.int64), x)] for x in (learned[0], ask[0])])
    p = suffix_tree_lm.branch([np.concatenate((a, b)) for a, b in zip(learned, ask, strict=True)], np.repeat([1, 0], [len(seen), len(ask[0])]), p_root)
    sums = p[len(seen) :].reshape(len(contexts), -1).sum(axis=1)
    assert np.allclose(sums, 1, rtol=0, atol=1e-9)


# ---------------------------------------------------------------- op5


def test_boundaries_are_optimal():
    rng = random.Random(6)
    for _ in range(30):
        lengths = sorted(rng.randrange(1, 40) for _ in range(25))
        cells = sorted(Counter(lengths).items())
        tops = packing.best_boundaries([v for v, _ in cells], [c for _, c in cells], [v * c for v, c in cells], 3)
        cost = lambda b: sum(min(x for x in b if x >= v) - v for v in lengths)
        kinds = [v for v, _ in cells]
        best = min(cost((a, b, kinds[-1])) for a in kinds for b in kinds)
        assert cost(tops) == best and len(tops) <= 3


def test_batches_fit_the_budget(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(words(rng, rng.randrange(0, 300)))) for i in range(500)] + [(600, " ".join(words(rng, 5000)))]
    rows = packing.pack(frame(spark, docs).repartition(7), 4, 1000).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in docs)
    by = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.boundary and r.n_tokens == len(plain(dict(docs)[r.doc_id]))
        by[r.bucket, r.batch].append(r)
    for (bucket, batch), rs in by.items():
        assert len(rs) == 1 or len(rs) * rs[0].boundary <= 1000
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    for b in {r.bucket for r in rows}:
        ordered = sorted((r for r in rows if r.bucket == b), key=lambda r: (r.batch, r.slot))
        assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in ordered)
        room = max(1, 1000 // ordered[0].boundary)
        assert all(r.batch == i // room for i, r in enumerate(ordered))


# ---------------------------------------------------------------- op6


def test_line_runs_agree_with_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", f"u{rng.randrange(40)}"]) for _ in range(rng.randrange(0, 25)))) for i in range(60)]
    for least in (2, 3):
        seen, want = set(), {}
        for i, t in docs:
            lines = t.split("\n")
            at = [k for k, x in enumerate(lines) if x.strip()]
            gone = set()
            for p in range(len(at) - least + 1):
                run = tuple(lines[k] for k in at[p : p + least])
                if run in seen:
                    gone |= set(at[p : p + least])
                seen.add(run)
            want[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, docs).repartition(4), least).collect()}
        assert got == want


# ---------------------------------------------------------------- op7


def test_leaks_exact_near_and_clean(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, rng.randrange(20, 50)))) for i in range(30)] + [(90, "one two three"), (91, None), (92, ""), (None, "x y")]
    fill = lambda n: " ".join(words(rng, n))
    near = items[1][1].split()
    near[0] = "changed"
    docs = [(1, f"{fill(30)} {items[0][1].upper()}, {fill(30)}"), (2, f"{fill(5)} {' '.join(near)}"), (3, fill(200)), (4, f"{fill(9)} One, two: three! {fill(3)}"), (5, items[2][1]), (6, " ".join(items[3][1].split()[:9]) + " " + fill(40))]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 0), (2, 1), (4, 90), (5, 2)} and got[1, 0] == 1.0 and 0.75 <= got[2, 1] < 1
    left = decontaminate.without_contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {3, 6}


def test_every_pair_in_the_radius_shares_a_block(spark):
    rng = random.Random(10)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randrange(0, decontaminate.RADIUS + 1)):
            b ^= 1 << k
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(F.arrays_overlap(decontaminate.blocks(F.col("a")), decontaminate.blocks(F.col("b")))).count() == 200


# ---------------------------------------------------------------- op8


def test_suffixes_remove_later_passages(spark):
    rng = random.Random(11)
    docs, planted = [], {}
    passages = [words(rng, n) for n in (51, 60, 75, 120, 400)]
    for i in range(60):
        text = words(rng, rng.randrange(20, 90))
        if i % 3 == 0:
            p = passages[(i // 3) % len(passages)]
            k = rng.randrange(len(text))
            planted[i] = (" ".join(p), (i // 3) % len(passages))
            text = text[:k] + p + text[k:]
        docs.append((i, " ".join(text)))
    docs.append((100, docs[1][1] + " " + docs[2][1]))
    docs.append((101, docs[-1][1]))
    got = {r.doc_id: r for r in suffix_dedup.dedup_suffixes(frame(spark, docs).repartition(5)).collect()}
    firsts = {}
    for i, (passage, k) in sorted(planted.items()):
        if k not in firsts:
            firsts[k] = i
            assert i not in got
        else:
            assert i in got and passage not in got[i].text and got[i].n_removed >= len(passage.split())
            assert got[i].n_removed <= len(passage.split()) + 4
    assert got[101].text.strip() == "" and set(got) <= {*planted, 100, 101}


def test_suffixes_remove_every_repeated_window(spark):
    rng = random.Random(17)
    docs, passages = [], [words(rng, 60) for _ in range(4)]
    for k, p in enumerate(passages):  # the first holds only part of the passage
        docs.append((200 * k, " ".join([*words(rng, 20), *p[:40], *words(rng, 20)])))
        docs += [(200 * k + i, " ".join([*words(rng, rng.randrange(5, 30)), *p, *words(rng, rng.randrange(5, 30))])) for i in range(1, 40)]
    docs.append((900, " ".join(passages[0] * 3)))
    seen, want = set(), {}
    for i, t in docs:
        w, gone = t.split(), set()
        for s in range(len(w) - 49):
            window = tuple(w[s : s + 50])
            if window in seen:
                gone |= set(range(s, s + 50))
            seen.add(window)
        if gone:
            want[i] = (len(gone), [x for k, x in enumerate(w) if k not in gone])
    got = {r.doc_id: (r.n_removed, r.text.split()) for r in suffix_dedup.dedup_suffixes(frame(spark, docs).repartition(5)).collect()}
    assert got == want and len(want) == 4 * 38 + 1


# ---------------------------------------------------------------- op9


def test_neighbours_have_recall_and_exact_scores(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:760] = x[700]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 3), (5004, []), (5005, [None] + [1.0] * 15), (None, x[0].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    got = defaultdict(list)
    for r in ann.search(df, lambda i: i % 20 == 0).collect():
        got[r.query_id].append(r)
    y, hits = x.astype(np.float64), 0
    assert set(got) == set(range(0, 1500, 20))
    for q, found in got.items():
        found.sort(key=lambda r: r.rank)
        s = y @ y[q]
        s[q] = -np.inf
        true = sorted(range(1500), key=lambda j: (-s[j], j))[:20]
        assert [r.rank for r in found] == list(range(1, 21)) and all(math.isclose(r.score, s[r.vec_id], rel_tol=1e-12, abs_tol=1e-12) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({r.vec_id for r in found} & set(true))
    assert hits >= 0.9 * 20 * 75


def test_few_vectors_give_all(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20, 25)], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.search(df, lambda i: i % 20 == 0).orderBy("rank").collect()] == [(20, 24), (20, 23), (20, 22), (20, 21)]
    assert ann.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", ["norms", "clusters"])
def test_nearest_neighbours_of_any_rows_are_all_found(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "norms":  # lengths from 1 to 10,000
        x = rng.standard_normal((2400, 32)) * np.exp(1.5 * rng.standard_normal((2400, 1)))
    else:  # a cluster far narrower than codewords are apart, equal vectors in it
        x = np.where(np.arange(2400)[:, None] % 3 == 0, rng.standard_normal(32) + 1e-6 * rng.standard_normal((2400, 32)), rng.standard_normal((2400, 32)))
        x[300:330] = x[300]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, 2400, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        assert got[q] == np.lexsort((np.arange(2400), -s))[:20].tolist()


# ---------------------------------------------------------------- op10


def components_by_force(docs, k=5):
    sets = {}
    for i, t in docs:
        w = plain(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    find = lambda i: i if comp[i] == i else find(comp[i])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_texts_of_pairs_are_dealt_once(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i % 2}") for i in (1, 2, 3, 3)], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 3), (1, 2)], "a long, b long")
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = ngram_join.verified(docs, pairs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.a, r.b, r.linked) for r in got.collect()) == [(1, 2, False), (1, 3, True)]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    # both joins read the exchange by doc_id that leaves one row of each, not a stored table that is dealt once more
    assert "ReusedExchange" in plan and "Aggregate" in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_agree_with_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # families of several blocks
        monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(seed)
    docs = []
    for i in range(260):
        if docs and rng.random() < 0.6:
            w = plain(rng.choice(docs)[1])
            for _ in range(rng.randrange(0, max(1, len(w) // 30) + 1)):
                if w:
                    w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                w = w[: max(1, int(len(w) * rng.uniform(0.6, 1)))]
        else:
            w = words(rng, rng.choice([0, 1, 3, 4, 5, 6, 8, 20, 60, 200, 400, 900]))
        docs.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(frame(spark, docs).repartition(6)).collect()}
    assert got == components_by_force(docs)


def test_texts_with_long_shared_passages_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(23)
    passage, docs = words(rng, 120), []
    for i in range(120):  # similarities from about 0.55 to 0.8, round the threshold
        own = words(rng, rng.randrange(8, 30))
        docs.append((i, " ".join(own + passage if i % 2 else passage + own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(frame(spark, docs).repartition(5)).collect()}
    assert got == components_by_force(docs)


def test_similar_sets_share_a_signature():
    rng = random.Random(13)
    for _ in range(400):
        n = rng.choice([1, 2, 3, 5, 10, 40, 96, 190, 255, 260, 300, 700, 1020, 1100, 3000])
        a = [rng.getrandbits(64) for _ in range(n)]
        drop = rng.randrange(0, n // 4 + 1)
        add = rng.randrange(0, max(0, (4 * (n - drop)) // 3 - n) + 1)
        b = a[drop:] + [rng.getrandbits(64) for _ in range(add)]
        both, whole = len(set(a) & set(b)), len(set(a) | set(b))
        x, y = (np.unique(np.array(s, np.uint64)) for s in (a, b))
        common = np.sort(np.array(rng.sample(a, rng.randrange(0, n + 1)), np.uint64))
        if 100 * both >= 75 * whole:
            sig, of = ngram_join.signatures([x, y], common)
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())
            odd = [b.column(1)[0].as_py() for s in (x, y) for b in [cells_of(s)]]
            assert len(ngram_join.possible(odd, np.array([len(x), len(y)]), lambda i, j: i < i + 1)[0]) == 1


def test_signatures_are_a_third_of_the_shingles_and_few_sets_share_one_by_chance():
    rng = np.random.default_rng(4)
    every = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    passage = every[:60]
    # sets of 150 in one band, a passage of 60 shingles in each: J is about a quarter
    sets = [np.unique(np.concatenate((passage, every[100 + 90 * i : 190 + 90 * i]))) for i in range(400)]
    sig, of = ngram_join.signatures(sets, np.zeros(0, np.uint64))
    assert np.bincount(of).max() <= 150 // 3 + 1
    # what is known to be common goes last, and parts with most of the rest first: no signature is made of the passage alone
    sig, of = ngram_join.signatures(sets, np.sort(passage))
    assert len(np.unique(sig)) == len(sig)


def test_families_tell_whether_the_forest_leaves_pairs_out():
    s = [np.sort(np.random.default_rng(5).integers(0, 1 << 63, 60, dtype=np.uint64))] * 3 + [np.arange(60, dtype=np.uint64)]
    cells = [cells_of(x).column(1)[0].as_py() for x in s]
    rows = [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (3, 3)]  # three equal sets; two; two that can't link
    table = pa.table({"family": [f for f, _ in rows], "block": [0] * 7, "doc": [10 * f + d for f, d in rows], "comp": [10 * f + d for f, d in rows], "n": [60] * 7, "home": [True] * 7, "cells": [cells[d] for _, d in rows]})
    got = {thin: sorted((r["a"] or 0, r["b"]) for r in ngram_join._near_pairs(thin)(table).to_pylist()) for thin in (True, False)}
    assert got[False] == [(10, 11), (10, 12), (11, 12), (20, 21)]
    assert (0, 1) in got[True] and (0, 2) not in got[True] and (0, 3) not in got[True] and len(got[True]) == 4


def cells_of(s):
    real, ngram_join._sets = ngram_join._sets, lambda batches: [(1, s)]
    try:
        return next(ngram_join._odd_cells(iter([None])))
    finally:
        ngram_join._sets = real


# ---------------------------------------------------------------- odd rows, empty tables


def no_labels(spark):
    return spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "some item of more than five words here"), (None, None)], "item_id long, text string").withColumn("len", F.lit(1))


OPERATORS = {
    "spans": lambda s, d: substring_dedup.dedup_spans(d), "licenses": lambda s, d: license_scan.scan_licenses(d), "quality": lambda s, d: quality.quality_scores(d, no_labels(s)),
    "lm": lambda s, d: suffix_tree_lm.score_texts(d, lambda i: F.crc32(i.cast("string")) % 7 == 2, lambda i: F.crc32(i.cast("string")) % 7 != 2), "packing": lambda s, d: packing.pack(d),
    "lines": lambda s, d: line_dedup.dedup_lines(d), "leaks": lambda s, d: decontaminate.contaminated(d, items(s)), "suffixes": lambda s, d: suffix_dedup.dedup_suffixes(d), "near": lambda s, d: ngram_join.near_copies(d),
    "keep_first": lambda s, d: ngram_join.keep_first(d), "keep_good": lambda s, d: quality.keep_good(d, no_labels(s)), "clean": lambda s, d: decontaminate.without_contaminated(d, items(s)),
}
#: How many rows each returns for the odd table of nine.
ROWS = {"spans": 1, "licenses": 9, "quality": 9, "lm": 9, "packing": 9, "lines": 9, "leaks": 0, "suffixes": 1, "near": 9, "keep_first": 8, "keep_good": 9, "clean": 9}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    df = odd(spark, random.Random(14))
    got = OPERATORS[name](spark, df).collect()
    assert len(got) == ROWS[name]
    if name in ("spans", "suffixes"):
        assert got[0].doc_id == 6
    assert OPERATORS[name](spark, df.limit(0)).count() == 0
