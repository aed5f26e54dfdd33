"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

First come the heads of the lists of all rows: for each dimension the HEAD rows
of the largest and of the smallest components, at most 2 x HEAD x dimensions
rows. A query scores all of them. What no head has shown scores at most the sum
of the query's components times the last values of the heads on the side that
helps it; if the k-th best score is above this bound, the query is done.

For the others that k-th score is a floor. Vectors are dealt into blocks of at
most BLOCK rows, in which every dimension has its list of rows sorted by
component. The lists are read from the end that helps the query; each row met
is scored whole. When neither the floor nor the block's own k-th best score can
be reached by what no list has shown yet, the rest of the block is not read; a
block whose first values stay under the floor is not read at all. Blocks'
results are merged. Equal scores go to the smaller id, hence a bound must be
beaten, not met.

Query blocks meet data blocks over salts, one for each PER_SALT data blocks, so
tasks grow with the rows and each query is copied once for each salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import by_key, written

BLOCK, QUERY_BLOCK, PER_SALT, HEAD = 4096, 1024, 8, 32
FIRST_DEPTH = 16
#: Tasks that gather the heads; each hands on at most 2 x HEAD x dimensions rows.
FIRST_TASKS = 256


class SortedLists:
    """A block's rows (in order of id) and its sorted lists."""

    def __init__(self, x: np.ndarray):
        self.x = x
        # products of float64 are exact while sums stay under 2 ** 53
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()  # (d, n) rising
        self.values = np.take_along_axis(x.T, self.order, 1)

    def top(self, q: np.ndarray, k: int, without: np.ndarray | None = None, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of the k best that reach the floor, and how many rows were scored. without: rows that don't count."""
        n = len(self.x)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        if floor is not None and n and self.values[up, n - 1] @ q[up] + self.values[down, 0] @ q[down] < floor:
            return np.zeros(0, int), np.zeros(0, np.int64), 0
        seen = np.zeros(n, bool)
        if without is not None:
            seen[without] = True
        rows, scores, depth, step, scored = np.zeros(0, int), np.zeros(0, np.int64), 0, FIRST_DEPTH, 0
        while depth < n:
            end = min(n, depth + step)
            met = np.concatenate([self.order[up, n - end : n - depth].ravel(), self.order[down, depth:end].ravel()]) if len(up) + len(down) else np.arange(n)
            new = np.zeros(n, bool)
            new[met] = True
            new = np.flatnonzero(new & ~seen)
            if len(up) + len(down) == 0:
                end = n
            if len(new):
                seen[new] = True
                scored += len(new)
                score = self.x[new] @ q
                if floor is not None:
                    new, score = new[score >= floor], score[score >= floor]
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, score])
                best = np.lexsort((rows, -scores))[:k]
                rows, scores = rows[best], scores[best]
            bound = self.values[up, n - end] @ q[up] + self.values[down, end - 1] @ q[down]
            if len(rows) == k and scores[-1] > bound or floor is not None and floor > bound:
                break
            depth, step = end, step * 2
        return rows, scores, scored


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _heads(x: np.ndarray, ids: np.ndarray, head: int) -> np.ndarray:
    """Rows that are among the `head` first of any list at either end, all equal ones of the last too up to `head` in order of id."""
    by_id = np.argsort(ids, kind="stable")
    order = by_id[np.argsort(x[by_id], axis=0, kind="stable")]
    return np.unique(np.concatenate([order[:head].ravel(), order[::-1][:head].ravel()])) if x.shape[1] else by_id[:head]


def _start(heads: np.ndarray, ids: np.ndarray, ends: tuple[np.ndarray, np.ndarray] | None, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows and scores of the k best heads, and whether no other row can be among the k. ends: the last values of the heads at the low and the high end, None if the heads are all rows."""
    score, others = heads @ q, np.flatnonzero(ids != own)
    best = others[np.lexsort((ids[others], -score[others]))[:k]]
    done = ends is None or len(best) == k and int(score[best[-1]]) > int(ends[1][q > 0] @ q[q > 0] + ends[0][q < 0] @ q[q < 0])
    return best, score[best], done


def _fitting(v: np.ndarray) -> np.ndarray:
    """v, rows of whole numbers; an error if inner products of such rows could be beyond a long. Of two sets of rows that pass alone, products of one with the other fit too."""
    if v.size and v.shape[-1] * float(np.abs(v.astype(np.float64)).max()) ** 2 >= 2.0**63:
        raise OverflowError("inner products do not fit a long")
    return v


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, head: int = HEAD) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over components floor(scale * x).

    Vectors that are null, of another length than the most frequent one or hold
    a null or non-finite component take no part, neither do null ids. A vector
    without components scores 0 with its like. A query is not its own
    candidate, rows with its id neither. Repeated query rows are asked once; of
    several vectors with one id the smallest by its components is the query.
    As candidates rows count each, repeated ones too. Components whose sums of products might not fit a long are an error. An empty table gives no rows; other columns are left out.
    """
    spark = vectors.sparkSession
    ok = lambda v: v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda df: df.where(F.col(id_col).isNotNull() & ok(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    rows = whole(vectors)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d = dims[0]["d"]
    rows, asked = rows.where(F.size("v") == d), whole(queries).where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = [], []

        def block() -> pa.RecordBatch:
            i, v = np.concatenate(ids), _fitting(np.concatenate(values))
            by_id = np.argsort(i, kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([len(i)]), pa.array([i[by_id].tobytes()], pa.binary()), pa.array([v[by_id].tobytes()], pa.binary())], ["n", "ids", "x"])

        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                c = b.slice(s, BLOCK)
                if sum(map(len, ids)) + c.num_rows > BLOCK and ids:
                    yield block()
                    ids, values = [], []
                ids.append(c.column(0).to_numpy())
                values.append(_matrix(c.column(1), d))
        if ids:
            yield block()

    def of(ids: bytes, x: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, np.int64), np.frombuffer(x, np.int64).reshape(n, d) if d else np.zeros((n, 0), np.int64)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The heads of a task's rows."""
        own, x = np.zeros(0, np.int64), np.zeros((0, d), np.int64)
        for b in batches:
            for n, ids, values in zip(*(b.column(c).to_pylist() for c in ("n", "ids", "x"))):
                i, v = of(ids, values, n)
                own, x = np.concatenate([own, i]), np.concatenate([x, v])
                few = _heads(x, own, head)
                own, x = own[few], x[few]
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array([len(own)]), pa.array([own.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["n", "ids", "x"])

    packed = "n long, ids binary, x binary"
    data = written(rows.mapInArrow(pack, packed), "blocks")
    n_rows, n_blocks = data.agg(F.sum("n"), F.count("*")).collect()[0]
    first = data.coalesce(FIRST_TASKS).mapInArrow(tops, packed).repartition(1).mapInArrow(tops, packed).collect()  # FIRST_TASKS rows meet in one task, which makes one row of at most 2 x head x d vectors
    head_ids, heads = of(first[0]["ids"], first[0]["x"], first[0]["n"])
    rising = np.sort(heads, axis=0)
    ends = None if len(heads) == n_rows else (rising[head - 1], rising[-head])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_start(heads, head_ids, ends, q, own, k) for own, q in zip(b.column(0).to_numpy(), _fitting(_matrix(b.column(1), d)))]
            best, scores = (pa.array([x.tolist() for x in c], pa.list_(pa.int64())) for c in ([head_ids[f[0]] for f in found], [f[1] for f in found]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), best, scores, pa.array([f[2] for f in found], pa.bool_())], ["vec_id", "v", "best", "scores", "done"])

    begun = written(asked.mapInArrow(begin, "vec_id long, v array<long>, best array<long>, scores array<long>, done boolean"), "begun")
    done = begun.where("done").select(F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("best", "scores")).alias("x")).select("query_id", F.col("x.best").alias("vec_id"), F.col("x.scores").alias("score"))
    more = begun.where("not done").select("vec_id", "v", F.when(F.size("scores") == k, F.element_at("scores", -1)).alias("floor"))
    salts, groups = max(1, n_blocks // PER_SALT), max(1, -(-more.count() // QUERY_BLOCK))
    grouped = more.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("asks"))
    wanted = written(grouped.select("asks", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")), "queries")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, ids, x, asks in zip(*(b.column(c).to_pylist() for c in ("n", "ids", "x")), b.column("asks")):
                ids, x = of(ids, x, n)
                lists = SortedLists(x)
                out = []
                for name, vector, floor in zip(asks.values.field(0).to_numpy(), _matrix(asks.values.field(1), d), asks.values.field(2).to_pylist()):
                    own = np.arange(np.searchsorted(ids, name), np.searchsorted(ids, name, "right"))
                    best, scores, _ = lists.top(vector, k, own, floor)
                    out.append((np.full(len(best), name), ids[best], scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    salted = data.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
    found = salted.join(by_key(wanted), "salt").select("n", "ids", "x", "asks").mapInArrow(scan, "query_id long, vec_id long, score long")
    ranked = found.unionByName(done).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
