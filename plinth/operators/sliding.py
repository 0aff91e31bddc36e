"""Exact percentiles over sliding windows of time, in time that grows with rows and the logarithm of different values.

Readings of a key are cut into blocks as long as the window. A reading goes to its own block and, as history, to the next one, so a block's group holds all that its windows can reach,
and a long or hot key is many groups; keys with few readings share one (by a hash). In a group the readings lie in the order of key and time, and the windows are ranges of that order.
A wavelet matrix over the ranks of their values answers all ranges at once: for each bit of a rank it keeps how many zeros come before each place, and a range is narrowed bit by bit to the
k-th smallest rank. Nothing is sorted or summed anew for a window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups of keys in each block of time.
GROUPS = 256

# Lower bounds of a reading's ratio to its trailing median, by level.
BANDS = (("veryBusy", 2.5), ("busy", 1.5), ("typical", 0.5), ("quiet", 0.0))


def kth_in_ranges(values: np.ndarray, start: np.ndarray, stop: np.ndarray, ks: Sequence[np.ndarray]) -> list[np.ndarray]:
    """For each of ``ks`` the k-th smallest (from 0) of ``values[start:stop]``; k must be inside of its range."""
    kinds, rank = np.unique(values, return_inverse=True)
    ranges = [[start.copy(), stop.copy(), k.copy(), np.zeros(len(k), np.int64)] for k in ks]
    now = rank.astype(np.int64)
    for bit in range(max(1, int(len(kinds) - 1).bit_length()) - 1, -1, -1):
        ones = (now >> bit) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - ones)))
        for r in ranges:
            a, b, k, found = r
            za, zb = zeros[a], zeros[b]
            up = k >= zb - za
            # zeros move to the front and ones behind them, both in order
            r[0], r[1] = np.where(up, zeros[-1] + a - za, za), np.where(up, zeros[-1] + b - zb, zb)
            r[2], r[3] = np.where(up, k - (zb - za), k), found | (up.astype(np.int64) << bit)
        now = np.concatenate((now[ones == 0], now[ones == 1]))
    return [kinds[r[3]] for r in ranges]


def percentiles_of_ranges(values: np.ndarray, start: np.ndarray, stop: np.ndarray, shares: Sequence[float]) -> list[np.ndarray]:
    """The percentiles of ``values[start:stop]``, linear between neighbours; NaN for empty ranges."""
    n = stop - start
    some = n > 0
    a, b, ks, parts = start[some], stop[some], [], []
    for s in shares:
        at = s * (n[some] - 1)
        low = np.floor(at).astype(np.int64)
        ks += [low, np.minimum(low + 1, n[some] - 1)]
        parts.append(at - low)
    out = []
    found = kth_in_ranges(values, a, b, ks) if len(a) else [np.zeros(0)] * len(ks)
    for i, part in enumerate(parts):
        low, high = found[2 * i].astype(float), found[2 * i + 1].astype(float)
        full = np.full(len(n), np.nan)
        full[some] = low + part * (high - low)
        out.append(full)
    return out


def trailing(readings: DataFrame, keys: Sequence[str], seconds: Column, value: str, days: int = 56, shares: Sequence[float] = (0.5, 0.9), names: Sequence[str] = ("median", "p90")) -> DataFrame:
    """``readings`` with the percentiles of the key's readings in the ``days`` before each one (seconds from -days to -1, itself left out) and ``samples``, their number.

    NULL readings are in no window, and have one themselves; rows with a NULL time get none. Percentiles of an empty window are NULL.
    """
    length = days * 86400
    cols = [f.name for f in readings.schema.fields]
    at = readings.select(*cols, seconds.cast("long").alias("_at"))
    block = F.floor(F.col("_at") / length).cast("long")
    own = at.where("_at is not null").select(*cols, "_at", block.alias("_block"), F.lit(0).alias("_past"))
    past = at.where(F.col("_at").isNotNull() & F.col(value).isNotNull()).select(*cols, "_at", (block + 1).alias("_block"), F.lit(1).alias("_past"))

    def run(t: pa.Table) -> pa.Table:
        when, asked = t.column("_at").to_numpy(), np.flatnonzero(t.column("_past").to_numpy() == 0)
        number = t.column(value).cast(pa.float64()).to_numpy()
        code = np.zeros(len(when), np.int64)
        for k in keys:
            # codes stay below the number of rows after each column
            kind = np.asarray(t.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1)).astype(np.int64) + 1
            code = np.unique(code * (kind.max(initial=0) + 1) + kind, return_inverse=True)[1]
        # a key's times lie within two windows, so keys that are further apart never meet
        low = int(when.min()) if len(when) else 0
        line = code * (4 * length) + (when - low)
        there = np.flatnonzero(~np.isnan(number))
        order = there[np.argsort(line[there], kind="stable")]
        at = line[order]
        a, b = np.searchsorted(at, line[asked] - length), np.searchsorted(at, line[asked])
        kept = t.take(pa.array(asked)).select(cols)
        for name, found in zip(names, percentiles_of_ranges(number[order], a, b, shares), strict=True):
            kept = kept.append_column(name, pa.array(found, pa.float64(), from_pandas=True))
        return kept.append_column("samples", pa.array(b - a, pa.int64()))

    added = [T.StructField(n, T.DoubleType()) for n in names] + [T.StructField("samples", T.LongType())]
    shared = F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).alias("_group")
    got = own.unionByName(past).groupBy(shared, "_block").applyInArrow(run, T.StructType([*readings.schema.fields, *added]))
    lost = at.where("_at is null").select(*cols, *(F.lit(None).cast("double").alias(n) for n in names), F.lit(0).cast("long").alias("samples"))
    return got.unionByName(lost)


def band(reading: Column, median: Column) -> Column:
    """The level of a reading by its ratio to the trailing median; without a scale (a median of 0) only zero is a level."""
    out = F.lit("quiet")
    for name, bound in reversed(BANDS):
        out = F.when(reading / median >= bound, name).otherwise(out)
    return F.when(reading.isNull() | median.isNull(), "unavailable").when(median == 0, F.when(reading == 0, "quiet").otherwise("unavailable")).otherwise(out)
