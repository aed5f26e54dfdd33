"""Nearest neighbours: an inverted file with product-quantised residuals, exact reranking and bounds on what coding loses.

Vectors go to the list of their nearest coarse centroid; the residual is coded
by one centroid number for each of PARTS subspaces. Beside its code a row keeps
its distance from what the code stands for, and each list its radius. Distances
between queries and codes come from a table for each list (a query's residual
against every centroid of every subspace).

A query first probes its nearest lists and reranks the nearest codes there by
exact distance; its k-th distance so far is a bound on the true one. Then it
goes to every list that its radius doesn't keep beyond the bound, and there
reranks every code whose distance less the row's own loss is within the bound.
By the triangle inequality no other row can be among the k nearest. So a fit
that suits the rows or queries badly costs work and not results.

Centroids and codebooks are fitted on a bounded sample; every row is indexed.
Equal vectors share one code, and of each such group only the k + 1 smallest
ids can be among k nearest (ties go to the smaller id, a query is not its own
neighbour), so a group of any size takes one place. Lists meet queries in
blocks of at most about BLOCK codes (fewer of long vectors: BLOCK_BYTES) and
QUERY_BLOCK queries, so a long list is dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from verdigris.llm.common import by_key, drop_written, written

FIT_ROWS, MAX_LISTS, PARTS, CENTROIDS = 20_000, 1024, 16, 256
#: What a query probes for its first bound: so many lists, more until they hold so many codes, and so many codes of a block.
LISTS, CODES, DEPTH = 8, 1000, 64
BLOCK, BLOCK_BYTES, QUERY_BLOCK, AT_ONCE = 16_384, 4 << 20, 4096, 128
#: Rounding moves a distance by less than this part of the lengths it is computed from; of direct sums of squares, of FINE.
ROUGH, FINE = 1e-6, 1e-9


@dataclass
class Index:
    center: np.ndarray  # (d,), subtracted from every vector, so that sums of squares keep their digits
    coarse: np.ndarray  # (lists, d)
    books: list[np.ndarray]  # a (centroids, width) for each subspace

    def edges(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([b.shape[1] for b in self.books])])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes, distances from the list's centroid and from what the code stands for."""
        x, e = x - self.center, self.edges()
        lists = nearest(x, self.coarse)
        rest = x - self.coarse[lists]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(e, e[1:], self.books)], 1).astype(np.uint8)
        return lists, codes, length(rest), length(rest - np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], 1))

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, codes) distances of residuals of queries, added up from a table for each subspace."""
        out, e = np.zeros((len(codes), len(rest))), self.edges()
        for k, (a, b, book) in enumerate(zip(e, e[1:], self.books)):
            out += squared(book, rest[:, a:b])[codes[:, k]]
        return np.sqrt(np.ascontiguousarray(out.T))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[s : s + 4096], centers).argmin(1) for s in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def length(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    r = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centers = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        n = np.bincount(own, minlength=len(centers))
        sums = np.stack([np.bincount(own, x[:, j], len(centers)) for j in range(x.shape[1])], 1)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def smallest(d: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest and of all equal to the last of these."""
    if len(d) <= k:
        return np.arange(len(d))
    return np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])


def fit_index(sample: np.ndarray, rows: int) -> Index:
    """sample: distinct vectors. The number of lists follows the root of `rows`, up to MAX_LISTS and an eighth of the sample: lists long enough that a query's table for one costs less than its codes."""
    center = np.median(sample, 0)
    sample = sample - center
    lists = max(1, min(MAX_LISTS, int(rows**0.5 / 2), len(sample) // 8))
    coarse = kmeans(sample, lists)
    rest = sample - coarse[nearest(sample, coarse)]
    widths = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
    return Index(center, coarse, [kmeans(rest[:, w], min(CENTROIDS, len(sample))) for w in widths])


def rerank(x: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k rows of x nearest to q (ties to the smaller id) that are within the bound, and their distances, squares added in order."""
    diff = x - q
    about = length(diff)
    near = np.flatnonzero(~(about > bound * (1 + FINE)))
    if len(near) > k:
        near = near[about[near] <= np.partition(about[near], k - 1)[k - 1] * (1 + FINE)]
    total = np.zeros(len(near))
    for part in diff[near].T:
        total += part * part
    exact = np.sqrt(total)
    first = np.lexsort((ids[near], exact))
    first = first[exact[first] <= bound][:k]
    return near[first], exact[first]


def _within(near: np.ndarray, loss: np.ndarray, rest: np.ndarray, rows: np.ndarray, limit: np.ndarray) -> list[np.ndarray]:
    """For each query the positions of rows within the limit: those that its distance to their codes doesn't rule out, by their distance up to rounding."""
    open_ = ~(near - loss > limit)
    some = np.flatnonzero(open_.any(0))
    open_[:, some] &= ~(np.sqrt(squared(rest, rows[some])) > limit)
    return [np.flatnonzero(o) for o in open_]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _unpacked(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def meet(asks: DataFrame, codes: DataFrame, index: Index, k: int, kind: str, depth: int | None) -> DataFrame:
    """query_id, own, first, score: of each block of codes the k nearest to each query that asks for its list, within the query's bound.

    asks: query_id, list, q, bound. depth: how many codes of a block are
    reranked, None: all that the bound doesn't rule out. first: the smallest id
    of the row's group that is not the query's.
    """
    size = max(1, min(BLOCK, BLOCK_BYTES // (np.dtype(kind).itemsize * len(index.center))))
    blocks = lambda df, n, name: df.groupBy("list").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    counts = written(blocks(asks, QUERY_BLOCK, "asking").join(blocks(codes, size, "asked"), "list"), "blocks", rows=MAX_LISTS)

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row in a block of its own side, for each block of the other side."""
        at = df.join(F.broadcast(counts), "list").withColumn(f"{own}_block", F.pmod(F.xxhash64(key), own).cast("int"))  # at most MAX_LISTS rows
        return at.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(own, other)

    def scan(key: tuple, asks: pa.Table, codes: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asks.num_rows and codes.num_rows:
            x, code, loss = _unpacked(codes["v"], kind).astype(float), _unpacked(codes["code"], "u1"), codes["loss"].to_numpy()
            group, rep, other = (codes[c].to_numpy() for c in ("own", "rep", "other"))
            q, ids, bounds = _unpacked(asks["q"], "f8"), asks["query_id"].to_numpy(), asks["bound"].to_numpy()
            at = index.coarse[key[0].as_py()]
            rows = x - index.center - at
            reach = codes["far"].to_numpy().max() + loss.max()
            for s in range(0, len(q), AT_ONCE):
                z = q[s : s + AT_ONCE] - index.center
                rest = z - at
                slack = ROUGH * (length(rest) + reach) + ROUGH**2 * (length(z) + length(at[None])[0])
                near, limit = index.distances(rest, code), (bounds[s : s + AT_ONCE] + slack)[:, None]
                wanted = [smallest(d, depth) for d in near] if depth else _within(near, loss, rest, rows, limit)
                for i, few in enumerate(wanted, s):
                    first = np.where(rep[few] == ids[i], other[few], rep[few])
                    few, first = few[first != ids[i]], first[first != ids[i]]
                    best, score = rerank(x[few], q[i], first, k, bounds[i])
                    found.append((np.full(len(best), ids[i]), group[few[best]], first[best], score))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query_id", "own", "first", "score"])

    keys = ["list", "asking_block", "asked_block"]
    left, right = dealt(asks, "query_id", "asking", "asked"), dealt(codes, "own", "asked", "asking")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id long, own long, first long, score double")


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of `vectors` by Euclidean distance, ties to the smaller id.

    queries: rows of vectors, repeated ones asked once; of several vectors with
    one id the smallest by its components is the query. Vectors that are null, all zeros, of another
    length than the most frequent one or hold a null or non-finite component
    take no part, neither do null ids. As candidates rows count each, repeated
    ones too. Other columns are left out. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    fine = lambda v: v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & fine(F.col("v")))
    rows = clean(vectors)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = dims[0]["d"]
    rows, asked = rows.where(F.size("v") == d), clean(queries).where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v"))

    # Groups of equal vectors: the k + 1 smallest ids, k rows of each; the first stands for all. An id may have several vectors, so groups have numbers of their own.
    same = Window.partitionBy(F.xxhash64("v"), "v")
    few = rows.withColumn("nth", F.dense_rank().over(same.orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    few = few.withColumn("copy", F.row_number().over(Window.partitionBy(F.xxhash64("v"), "v", "vec_id").orderBy("nth"))).where(F.col("copy") <= k)
    few = few.withColumn("own", F.monotonically_increasing_id()).withColumn("own", F.min("own").over(same)).withColumn("rep", F.min("vec_id").over(same))
    members = few.withColumn("other", F.coalesce(F.min(F.when(F.col("nth") == 2, F.col("vec_id"))).over(same), "rep"))
    members, asked = written(members, "members"), written(asked, "asked")
    reps = members.where("nth = 1 AND copy = 1").select("own", "rep", "other", "v")
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).collect()
    index = fit_index(np.array([r["v"] for r in sample]), reps.count())
    kind = "f4" if vectors.schema[vector_col].dataType.elementType == FloatType() else "f8"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                lists, codes, far, loss = index.encode(x)
                packed = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (codes, x.astype(kind))]
                yield pa.RecordBatch.from_arrays([b.column("own"), b.column("rep"), b.column("other"), pa.array(lists.astype(np.int32)), *packed, pa.array(far), pa.array(loss)], ["own", "rep", "other", "list", "code", "v", "far", "loss"])

    codes = written(reps.mapInArrow(encode, "own long, rep long, other long, list int, code binary, v binary, far double, loss double"), "codes")
    size, radius = np.zeros(len(index.coarse), int), np.full(len(index.coarse), -np.inf)
    for r in codes.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # at most MAX_LISTS rows
        size[r["list"]], radius[r["list"]] = r["n"], r["far"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without a bound to the nearest lists, else to all that the bound doesn't rule out."""
        for b in batches:
            if b.num_rows:
                q = _matrix(b.column("v"))
                z = q - index.center
                apart = np.sqrt(squared(z, index.coarse))
                if "bound" in b.schema.names:
                    bounds = b.column("bound").to_numpy()
                    slack = ROUGH * (length(z)[:, None] + length(index.coarse) + np.maximum(radius, 0))
                    wanted = (size > 0) & ~(apart - radius > bounds[:, None] + slack)
                else:
                    bounds, order = np.full(len(q), np.inf), apart.argsort(1, kind="stable")
                    before = size[order].cumsum(1) - size[order]
                    wanted = np.zeros(apart.shape, bool)
                    np.put_along_axis(wanted, order, (np.arange(len(size)) < LISTS) | (before < CODES), 1)
                who, lists = wanted.nonzero()
                packed = pa.array([row.tobytes() for row in q], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(who)), pa.array(lists.astype(np.int32)), packed.take(pa.array(who)), pa.array(bounds[who])], ["query_id", "list", "q", "bound"])

    sent = "query_id long, list int, q binary, bound double"
    nearby = written(asked.mapInArrow(send, sent), "nearby")
    by_score = Window.partitionBy("query_id").orderBy("score", "first")
    placed = lambda df: df.withColumn("at", F.row_number().over(by_score))
    bounds = placed(meet(nearby, codes, index, k, kind, DEPTH)).where(F.col("at") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    bounded = written(asked.join(by_key(bounds), "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), "bounded")
    within = written(bounded.mapInArrow(send, sent), "within")
    best = written(placed(meet(within, codes, index, k, kind, None)).where(F.col("at") <= k).select("query_id", "own", "score"), "best")
    drop_written(asked, codes, nearby, bounded, within)
    scored = best.join(by_key(members.select("own", "vec_id")), "own").where("vec_id <> query_id")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
