"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters and digits, lower-cased. A window of an item's own
length is laid over a text wherever one of its five-word shingles falls on the place that the shingle has in
some item (a window without a shingle in common can't reach the threshold, so no other place matters).
Each window and each item get a 64-bit SimHash of their words. Fingerprints are cut into ``RADIUS + 1`` blocks: two
that differ in at most ``RADIUS`` bits agree in one block, so a join on (length, block, its bits) finds *every* pair within
the radius; the pairs' distance is then taken exactly. Survivors are verified by the weighted Jaccard similarity of their
shingles (weights: occurrences; sum of minima over sum of maxima), ``0.75`` or more.

All of it is DataFrame functions. A passage in very many texts makes a few windows in each, never
pairs of texts; items are broadcast only when their counted number is small.

Defined cases: null and empty texts and items match nothing; an item with fewer than five words is one shingle, its
whole sequence; near the ends of a text a window is moved inside, and a shorter text is one window; repeated rows of a doc_id
and text are one document; rows with a null doc_id or item_id are left out; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm import jobs

SHINGLE = 5
SIMILARITY = 0.75
#: Bits: windows with a similarity of 0.75 were found up to 20 apart, so the radius loses none of them.
RADIUS = 24
_BITS = 64


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def shingle_hashes(w: Column, k: int = SHINGLE) -> Column:
    """Hashes of the ``k``-word shingles of an array of words, in order; none if it is shorter."""
    starts = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k))
    return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))


def simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The fingerprint of each key's words: (keys, fp); ``rows`` has an array column ``w``."""
    each = rows.select(*keys, F.explode("w").alias("word")).select(*keys, F.xxhash64("word").alias("h"))
    votes = each.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(_BITS)))
    fp = reduce(lambda a, b: a.bitwiseOR(b), (F.when(2 * F.col(f"b{b}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(_BITS)))
    return votes.select(*keys, fp.alias("fp"))


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """The fingerprint's blocks as an array of (block, bits)."""
    edges = [round(i * _BITS / (radius + 1)) for i in range(radius + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingle hashes as bags."""
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, h: acc + F.least(F.size(F.filter(a, lambda x: x == h)), F.size(F.filter(b, lambda x: x == h))))
    whole = F.size(a) + F.size(b) - common
    return F.when(whole > 0, common / whole).otherwise(F.lit(0.0))


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word) of every text with a window similar to an item; the best window, then the first."""
    keyed = jobs.with_doc_key(docs).where("doc_id is not null and text is not null")
    bench = jobs.cut(items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where("w[0] <> ''").distinct().withColumn("len", F.size("w")))
    few = bench.count() <= jobs.BROADCAST_IDS // 50
    small = F.broadcast if few else (lambda df: df)
    sizes = [SHINGLE, *(r.len for r in bench.where(F.col("len") < SHINGLE).select("len").distinct().orderBy("len").collect())]
    # places that windows are laid from: a shingle, its place in an item, the item's length
    grams = {k: bench.where(F.col("len") >= k if k == SHINGLE else F.col("len") == k).select("len", F.posexplode(shingle_hashes(F.col("w"), k)).alias("at", "h")).distinct() for k in sizes}
    texts = keyed.select("doc_id", "copy", words(F.col("text")).alias("w"))
    laid = None
    for k, known in grams.items():
        found = (
            texts.select("doc_id", "copy", F.size("w").alias("n"), F.posexplode(shingle_hashes(F.col("w"), k)).alias("p", "h"))
            .join(small(known), "h")
            .select("doc_id", "copy", F.greatest(F.lit(0), F.least(F.col("p") - F.col("at"), F.col("n") - F.col("len"))).alias("start"), "len")
            .distinct()
        )
        laid = found if laid is None else laid.union(found)
    places = jobs.cut(laid.distinct().groupBy("doc_id", "copy").agg(F.collect_set(F.struct("start", "len")).alias("places")))
    n = places.agg(F.sum(F.size("places"))).first()[0] or 0
    inside = keyed.join(F.broadcast(places) if n <= jobs.BROADCAST_IDS else places, ["doc_id", "copy"]).dropDuplicates(["doc_id", "copy"])
    windows = jobs.cut(inside.select("doc_id", "copy", words(F.col("text")).alias("all"), F.explode("places").alias("p")).select("doc_id", "copy", "p.start", "p.len", F.slice("all", F.col("p.start") + 1, F.col("p.len")).alias("w")))
    keys = ["doc_id", "copy", "start", "len"]
    prints = windows.join(simhash(windows, keys), keys)
    marked = bench.join(simhash(bench, ["item_id", "len"]), ["item_id", "len"]).select("item_id", "len", F.col("w").alias("item"), F.col("fp").alias("item_fp"))
    indexed = marked.select("*", F.explode(blocks(F.col("item_fp"), radius)).alias("x")).select("*", "x.block", "x.bits").drop("x")
    pairs = (
        prints.select("*", F.explode(blocks(F.col("fp"), radius)).alias("x")).select("*", "x.block", "x.bits").drop("x")
        .join(small(indexed), ["len", "block", "bits"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        # of the blocks in which a pair agrees only the first counts
        .where(F.col("block") == reduce(lambda rest, i: F.when(_same_block(i, radius), i).otherwise(rest), range(radius, -1, -1), F.lit(-1)))
    )
    k = F.least(F.lit(SHINGLE), F.col("len"))
    scored = pairs.select("doc_id", "item_id", "start", _similar("w", "item", k).alias("similarity")).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("at"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.at")).cast("long").alias("first_word"))


def _same_block(i: int, radius: int) -> Column:
    a, b = round(i * _BITS / (radius + 1)), round((i + 1) * _BITS / (radius + 1))
    return F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("item_fp")), a).bitwiseAND(F.lit((1 << (b - a)) - 1)) == 0


def _similar(a: str, b: str, k: Column) -> Column:
    """Similarity by shingles of five words, or of all words of a shorter item."""
    out = F.lit(0.0)
    for size in range(1, SHINGLE + 1):
        out = F.when(k == size, weighted_similarity(shingle_hashes(F.col(a), size), shingle_hashes(F.col(b), size))).otherwise(out)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    ids = jobs.cut(contaminated(docs, items).select("doc_id").distinct())
    return jobs.anti(docs, ids, "doc_id")
