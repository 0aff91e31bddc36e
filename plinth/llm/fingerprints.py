"""Document fingerprints by consistent weighted sampling.

A text's terms are its words (lower-cased), each with the four words before it (fewer at the start of the text), and a
term's weight is the number of times it occurs. For each of ``SAMPLES`` samples a term draws, from its hash alone, r and c from a Gamma(2, 1)
distribution and b evenly from 0 to 1; with t = floor(ln(weight) / r + b) its level is c * exp(-r * (t - b + 1)), and the term with the lowest level
is the sample. Two bags of terms pick the same (term, t) with a probability of exactly their generalised Jaccard similarity (sum of minima over sum of maxima of the weights).
The level is a function of the sample number, the term and t only, so the lowest level itself stands for the pick: a sample is one minimum, and a fingerprint is as many
minima as there are samples, each kept as 16 bits of its hash (4 hexadecimal digits). The likeness of two fingerprints is the share of equal samples: its
standard error is at most 0.5 / sqrt(SAMPLES), and chance equality of unequal samples adds 2 ** -16.

All of it is DataFrame functions. The documents are dealt once, by ranges of doc_id, so that a document and the one after it meet in one task; all that
follows needs no other exchange: terms are counted inside their row's sorted array, and the minima are taken in the task that holds the row. The first documents of every range are also
handed to the range before, so no range waits for another. There are several ranges to a task, of much the same number of rows.

Defined cases: null and empty texts have no terms and fingerprints of empty samples (alike among themselves, unlike all others); rows with a null doc_id are left out; rows that repeat a doc_id are documents of
their own, one after the other in the order of their texts; a single document is followed by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm import jobs

SAMPLES = 64
SHINGLE = 5
#: Digits of a sample in the fingerprint.
DIGITS = 4
#: Ranges of doc_id: several to a task, and more when they would hold more than so many rows.
RANGES_A_TASK, ROWS_A_RANGE = 8, 100_000


def with_shingles(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``text`` replaced by ``name``: a hash of each of its words together with the words before it, ``SHINGLE`` in all where there are as many."""
    rest = [c for c in df.columns if c != text]
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    df = df.select(*rest, F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))
    # a word before the start is a null, which a hash passes over
    return df.select(*rest, F.transform("_w", lambda w, i: F.xxhash64(*(F.get(F.col("_w"), i - k) for k in range(SHINGLE - 1, 0, -1)), w)).alias(name))


def weighted(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """``df`` with ``hashes`` (an array, repeats count) replaced by ``name``: an array of (h, w), each distinct hash with its number."""
    rest = [c for c in df.columns if c != hashes]
    df = df.select(*rest, F.sort_array(hashes).alias("_s"))
    new = F.zip_with("_s", F.concat(F.array(F.lit(None).cast("long")), F.col("_s")), lambda a, b: F.when(~a.eqNullSafe(b), a))
    df = df.select(*rest, F.size("_s").alias("_n"), F.filter(F.transform(new, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: x.h.isNotNull()).alias("_f"))
    after = F.concat(F.slice(F.transform("_f", lambda x: x.i), 2, F.greatest(F.lit(1), F.size("_f"))), F.array("_n"))
    # "after" has one entry more where there are no terms at all
    return df.select(*rest, F.filter(F.zip_with("_f", after, lambda x, e: F.struct(x.h.alias("h"), (e - x.i).cast("double").alias("w"))), lambda t: t.h.isNotNull()).alias(name))


def _even(bits: Column, n: int) -> Column:
    """Evenly from 0 to 1 by ``n`` bits, never 0 nor 1."""
    return (bits + F.lit(0.5)) * F.lit(2.0**-n)


def lightest(h: Column, sample: int | Column) -> Column:
    """The level of a term of weight 1, as the probability that it is lower."""
    return _even(F.shiftrightunsigned(F.xxhash64(h, F.lit(sample) if isinstance(sample, int) else sample), 12), 52)


def heavier(h: Column, weight: Column) -> Column:
    """The levels of a term of another weight in every sample, on the same scale; equal to those of weight 1 where both pick the same t.

    With a Gamma(2, 1) variable c and an even u, c * u and c * (1 - u) are two independent exponential ones, and so are r * b and r * (1 - b). So the level
    c * exp(-r * (1 - b)) at a weight of 1 is an exponential variable f itself, and r, c and b follow from it and two more: c = f + g,
    r * (1 - b) = ln(c / f), r * b = e. Only terms with another weight need them: their level is f * exp(-r * t), t = floor(ln(weight) / r + b).
    """
    drawn = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.struct(lightest(h, i).alias("low"), F.xxhash64(h, i, i).alias("y")))
    exponential = F.transform(drawn, lambda d: F.struct(d.low.alias("low"), (-F.log1p(-d.low)).alias("f"), (-F.log(_even(F.shiftrightunsigned(d.y, 32), 32))).alias("g"), (-F.log(_even(d.y.bitwiseAND(F.lit(0xFFFFFFFF)), 32))).alias("e")))
    gamma = F.transform(exponential, lambda d: F.struct(d.low.alias("low"), d.f.alias("f"), d.e.alias("e"), (F.log((d.f + d.g) / d.f) + d.e).alias("r")))
    picked = F.transform(gamma, lambda d: F.struct(d.low.alias("low"), d.f.alias("f"), d.r.alias("r"), F.floor((F.log(weight) + d.e) / d.r).alias("t")))
    return F.transform(picked, lambda d: F.when(d.t == 0, d.low).otherwise(-F.expm1(-d.f * F.exp(-d.r * d.t))))


def minima(rows: DataFrame, keys: list[str], terms: str) -> DataFrame:
    """(keys, samples): ``terms`` is an array of (h, w > 0) of each row; samples is an array of 16-bit numbers, 0 where there are no terms."""
    each = rows.select(*keys, F.explode_outer(terms).alias("_t")).select(*keys, F.col("_t.h").alias("_h"), F.when(F.col("_t.w") != 1, heavier(F.col("_t.h"), F.col("_t.w"))).alias("_l"))
    # a missing term has no hash, and no level
    least = each.groupBy(*keys).agg(*(F.min(F.when(F.col("_l").isNotNull(), F.get("_l", F.lit(i))).when(F.col("_h").isNotNull(), lightest(F.col("_h"), i))).alias(f"_m{i}") for i in range(SAMPLES)))
    kept = F.transform(F.array(*(f"_m{i}" for i in range(SAMPLES))), lambda m: F.when(m.isNull(), 0).otherwise(F.xxhash64(m).bitwiseAND(F.lit(0xFFFF))).cast("int"))
    return least.select(*keys, kept.alias("samples"))


def fingerprint(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x), DIGITS, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(SAMPLES))


def edited(text: Column, following: Column) -> Column:
    """The text, its last half replaced by as much of the following text's beginning."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the rising bounds the key reaches, by halving."""
    steps = F.array(*(F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)))
    at = F.array(*(F.lit(b) for b in bounds)).cast("array<bigint>")
    return F.aggregate(steps, F.lit(0), lambda low, p: F.when(F.get(at, low + p - 1) <= key, low + p).otherwise(low))


def _bounds(ids: DataFrame) -> list[int]:
    """Where ranges of doc_id start: one number a range, from the ids alone."""
    n = max(RANGES_A_TASK * jobs.partitions(ids.sparkSession), ids.count() // ROWS_A_RANGE)
    parts = ids.repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low"))
    return sorted({r.low for r in parts.collect()})[1:]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document; the next one is that of the next lower doc_id, after the last comes the first."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null")
    bounds = _bounds(ids)
    part = _range_of(F.col("doc_id"), bounds).alias("part")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")
    # the highest document of a range goes to the next range above too, that of the highest range to the lowest: as many rows as ranges
    ranges = Window.orderBy("part")
    tops = ids.select("doc_id", part).groupBy("part").agg(F.max("doc_id").alias("doc_id"))
    handed = tops.select("doc_id", F.coalesce(F.lead("part").over(ranges), F.min("part").over(ranges.rowsBetween(Window.unboundedPreceding, 0))).alias("part"))
    own = keyed.select(part, "doc_id", "text", F.lit(0).alias("turn"))
    lent = keyed.join(F.broadcast(handed), "doc_id").select("part", "doc_id", "text", F.lit(1).alias("turn"))
    order = Window.partitionBy("part").orderBy("turn", F.desc("doc_id"), "text")
    rows = own.union(lent).select("part", "doc_id", "turn", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))
    rows = rows.select("part", "place", "turn", "doc_id", "text", F.when(F.col("turn") == 0, edited(F.col("text"), F.col("next"))).alias("edited"))
    base = ["part", "place", "turn", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")]
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    texts = rows.select(*base, F.explode(kinds).alias("x")).where("x.t is not null")
    keys = ["part", "place", "turn", "doc_id", "n_chars", "edited_sha256", "kind"]
    texts = with_shingles(texts.select(*keys[:-1], "x.kind", "x.t"), "t", "hashes")
    found = minima(weighted(texts, "hashes", "terms"), keys, "terms")
    # a row is followed by its edited text's, and that by the next document's
    by_place = Window.partitionBy("part").orderBy("place", "kind")
    out = found.select(*keys, "samples", F.lead("samples").over(by_place).alias("e"), F.lead("samples", 2).over(by_place).alias("next")).where("kind = 0 and turn = 0")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("samples")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("samples"), F.col("e")).alias("near_edited"), likeness(F.col("samples"), F.col("next")).alias("near_next"),
    )
