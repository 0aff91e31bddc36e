"""Nearest neighbours by inner product: inverted file of coarse centroids, product-quantised residuals with their error, exact check of what the codes cannot rule out.

Equal vectors are one entry with its ``K + 1`` smallest ids (no query can need more of them), so a vector that a third of
all rows share is one entry. Coarse centroids and the residuals' codebooks are fitted by k-means on at most
``TRAIN_ROWS`` entries, those with the smallest hash; *every* entry is then put into the list of its nearest centroid
with one byte for each of ``dim / SUB`` parts of its residual and the length of what the codes leave (its error). Lists are packed
into blocks of about ``BLOCK`` entries, so a hot list is many blocks, and queries that probe a list into chunks of about as many
queries. A block meets a chunk in one equi-join row: per query a table of inner products with all codewords (asymmetric distance),
one look-up for each part of each code.

Nothing is cut by number. A query starts with a floor, its (k + 1)-th largest inner product with ``FLOOR_ROWS`` entries of the sample: no entry below it
can be among its nearest. By the inequality of Cauchy and Schwarz an entry's inner product is at most its approximate one plus the query's length
times the entry's error, and a list's at most the centroid's plus that length times the list's radius. A query probes every list whose
bound reaches the floor, and in a block the inner products of every entry whose bound reaches it are computed from the original vectors in double precision; the floor rises
with what is found. So the rows are those of brute force whatever the vectors are (norms of any spread, tight clusters, vectors that are no cluster at all); the sample, ``SUB`` and
the number of lists only set the work, which is at most all pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an
id or vectors of another length than the most common one (the smaller at a tie); ties go to the smaller id; repeated
rows of an id and vector are one row; fewer candidates than ``K`` are all returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm import jobs

K = 20
TRAIN_ROWS = 20_000
FLOOR_ROWS = 8192
SUB = 2
BLOCK = 1024

#: Share of the lengths that rounding may take from or add to an inner product, and a length below which squares vanish.
ROUNDING, TINY = 1e-11, 1e-150


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    ok = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    ok = ok.where(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0)).distinct()
    ok = jobs.cut(ok)
    dims = sorted((-r["count"], r.d) for r in ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect())
    return ok.where(F.size("v") == (dims[0][1] if dims else 0))


def entries(ok: DataFrame, keep: int = K + 1) -> DataFrame:
    """(id, ids, v): each distinct vector with its smallest ids."""
    order = Window.partitionBy("v").orderBy("id")
    first = ok.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    return first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "ids", "v")


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """``k`` centroids of the rows of ``x`` (as many as rows, if fewer)."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1)) + TINY


def products(x: np.ndarray, at: np.ndarray, q: np.ndarray, of: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Inner products of rows ``at`` of ``x`` with rows ``of`` of ``q``."""
    return np.concatenate([(x[at[i : i + step]] * q[of[i : i + step]]).sum(axis=1) for i in range(0, len(at), step)]) if len(at) else np.zeros(0)


def nearest_of_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, best: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of the block's entries that can be among a query's ``best.shape[1]`` best; raises ``best`` and ``floor``.

    ``bound`` is at least the inner product (queries by entries); what is not below the floor (NaN too) is computed.
    """
    k = best.shape[1]
    can = ~(bound < floor[:, None])
    many = np.flatnonzero(can.sum(axis=1) > 4 * k)
    if len(many):  # a floor that is too low for this block: the scores of the highest bounds raise it
        top = np.argpartition(-bound[many], k - 1, axis=1)[:, :k]
        least = products(x, top.ravel(), q, np.repeat(many, k)).reshape(-1, k).min(axis=1)
        floor[many] = np.fmax(floor[many], least)
        can[many] = ~(bound[many] < floor[many, None])
    of, at = np.nonzero(can)
    score = products(x, at, q, of)
    keep = ~(score < floor[of])
    of, at, score = of[keep], at[keep], score[keep]
    order = np.lexsort((ids[at], -score, of))
    of, at, score = of[order], at[order], score[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    of, at, score, place = (a[place < k] for a in (of, at, score, place))
    new = np.full(best.shape, -np.inf)
    new[of, place] = score
    best[:] = -np.sort(-np.concatenate((best, new), axis=1), axis=1)[:, :k]
    np.fmax(floor, best[:, -1], out=floor)
    return of, at, score


class Index:
    """Coarse centroids and codebooks."""

    def __init__(self, sample: np.ndarray, total: int):
        dim = sample.shape[1]
        lists = int(max(1, min(round(total**0.5 / 4), len(sample) // 8 or 1)))
        self.some = sample[:FLOOR_ROWS]
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.edges = [*range(0, dim, SUB), dim]
        self.books = [kmeans(rest[:, a:b], 256, 5) for a, b in zip(self.edges, self.edges[1:], strict=False)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = nearest(x, self.coarse)
        rest = x - self.coarse[near]
        return near, np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(zip(self.edges, self.edges[1:], strict=False), self.books, strict=True)], axis=1).astype(np.uint8)

    def decode(self, near: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.coarse[near] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)

    def errors(self, x: np.ndarray, near: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each entry's distance from its decoded vector and from its centroid."""
        long = ROUNDING * (lengths(x) + 2 * lengths(self.coarse)[near])
        return lengths(x - self.decode(near, codes)) * (1 + ROUNDING) + long, lengths(x - self.coarse[near]) * (1 + ROUNDING) + long

    def floor(self, q: np.ndarray, k: int) -> np.ndarray:
        """What each query's ``k`` nearest, itself left out, reach at least: k + 1 entries of the sample do."""
        if len(self.some) <= k:
            return np.full(len(q), -np.inf)
        near = np.partition(q @ self.some.T, len(self.some) - k - 1, axis=1)[:, len(self.some) - k - 1]
        return near - ROUNDING * lengths(q) * lengths(self.some).max()

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Inner products of the codewords of every part with each query: they hold for all lists."""
        return [book @ q[:, a:b].T for (a, b), book in zip(zip(self.edges, self.edges[1:], strict=False), self.books, strict=True)]

    def approximate(self, q: np.ndarray, tables: list[np.ndarray], list_no: int, codes: np.ndarray) -> np.ndarray:
        out = np.repeat((q @ self.coarse[list_no])[None, :], len(codes), axis=0)
        for j, table in enumerate(tables):
            out += table[codes[:, j]]  # whole rows of queries
        return out.T


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _packed(df: DataFrame, what: str) -> DataFrame:
    """Rows (list, id, data) as (list, ids, data) packs of about BLOCK rows."""
    sizes = df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    cut = df.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        return pa.table({"list": table.column("list")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([b"".join(table.column("data").to_pylist())], pa.binary())})

    return cut.select("list", "part", "id", "data").groupBy("list", "part").applyInArrow(pack, "list int, ids binary, data binary").select("list", F.col("ids").alias(f"{what}_ids"), F.col("data").alias(f"{what}_data"))


def search(rows: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row for which ``is_query(id column)`` holds."""
    spark = rows.sparkSession
    jobs.small_batches(spark)
    ok = jobs.cut(usable(rows, id_col, vec_col))
    schema = "query_id long, rank int, vec_id long, score double"
    every = jobs.cut(entries(ok, k + 1))
    total = every.count()
    if not total:
        return spark.createDataFrame([], schema)
    sample = every.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).select("v").toPandas()
    index = spark.sparkContext.broadcast(Index(np.stack(sample["v"].to_numpy()), total))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            near, codes = index.value.encode(x)
            error, radius = index.value.errors(x, near, codes)
            data = [c.tobytes() + v.tobytes() for c, v in zip(codes, np.column_stack((error, x)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), b.column(0), pa.array(data, pa.binary()), pa.array(radius)], names=["list", "id", "data", "radius"])

    coded = jobs.cut(every.select("id", "v").mapInArrow(encode, "list int, id long, data binary, radius double"))
    reach = np.full(len(index.value.coarse), -np.inf)  # of lists without entries
    for r in coded.groupBy("list").agg(F.max("radius").alias("radius")).collect():
        reach[r["list"]] = r["radius"]

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(512, (1 << 16) // len(reach)))
        for b in batches:
            every_q, every_id = _matrix(b.column(1)), b.column(0).to_numpy()
            for i in range(0, len(every_q), step):
                q = every_q[i : i + step]
                floor = index.value.floor(q, k)
                of, lists = np.nonzero(~(q @ index.value.coarse.T + lengths(q)[:, None] * reach < floor[:, None]) & (reach != -np.inf))
                data = [x.tobytes() for x in np.column_stack((floor, q))]
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(every_id[i : i + step][of]), pa.array([data[j] for j in of], pa.binary())], names=["list", "id", "data"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the chunks of queries that a list's blocks meet in turn: tables of the last ones, the best found of more
        held: dict[bytes, list[np.ndarray]] = {}
        so_far: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for i in range(b.num_rows):
                n, ids = b.column(0)[i].as_py(), np.frombuffer(b.column(1)[i].as_py(), np.int64)
                raw = np.frombuffer(b.column(2)[i].as_py(), np.uint8).reshape(len(ids), -1)
                parts = len(index.value.books)
                codes, rest = raw[:, :parts], np.ascontiguousarray(raw[:, parts:]).view(np.float64)
                error, x = rest[:, 0], np.ascontiguousarray(rest[:, 1:])
                q_ids = np.frombuffer(b.column(3)[i].as_py(), np.int64)
                asked = np.frombuffer(b.column(4)[i].as_py(), np.float64).reshape(len(q_ids), -1)
                q, chunk = np.ascontiguousarray(asked[:, 1:]), q_ids.tobytes()
                if chunk not in held:
                    if len(held) == 2:
                        held.pop(next(iter(held)))
                    held[chunk] = index.value.tables(q)
                if chunk not in so_far:
                    if len(so_far) == 64:
                        so_far.pop(next(iter(so_far)))
                    so_far[chunk] = np.full((len(q), k + 1), -np.inf), asked[:, 0].copy()
                bound = index.value.approximate(q, held[chunk], n, codes) + lengths(q)[:, None] * error
                of, at, score = nearest_of_block(x, ids, q, bound, *so_far[chunk])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[of]), pa.array(ids[at]), pa.array(score)], names=["query_id", "id", "score"])

    queries = jobs.cut(ok.where(is_query(F.col("id"))))
    blocks = _packed(coded.select("list", "id", "data"), "block")
    asked = _packed(queries.mapInArrow(probes, "list int, id long, data binary"), "query")
    found = blocks.join(asked, "list").select("list", "block_ids", "block_data", "query_ids", "query_data").mapInArrow(scan, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("query_id", "id", "score")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.join(every.select("id", "ids"), "id").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
