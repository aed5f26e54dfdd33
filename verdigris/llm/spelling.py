"""Spelling variants: words one edit apart, found as points in rectangles of two orders."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import by_key, drop_written, joined_apart, small_batches, written

#: Fixed value: what a word is made of by default.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Different words that a task counts before it passes them on.
COUNTED_AT_ONCE = 200_000
#: A group of more rows is split in two by where the edit is.
GROUP_ROWS = 20_000
#: Rows, and code points of their words, that one wavelet tree is made for, and rectangles asked of it at once.
TREE_ROWS, TREE_CELLS, ASKED_AT_ONCE = 50_000, 8_000_000, 400_000
_FOUND = "word string, n_near long, near string, near_n long"

Change = Callable[[int | None, str], str]
_SMALL = {c: c + 32 for c in range(65, 91)}


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = LETTERS, min_length: int = 5, min_count: int = 3, change: Change | None = None) -> DataFrame:
    """word, n long: the maximal runs of `pattern` in the whole texts, A-Z in lower case, of min_length code points and min_count occurrences or more.

    change(id, word) may replace a document's word before its length is looked
    at. Null texts have no words; the id may be null and repeated, each row
    counts. A task sums up its words before they move.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = re.compile(pattern).findall, Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                here: Counter = Counter()
                for word, n in Counter(find(text.as_py() or "")).items():
                    here[word.lower() if word.isascii() else word.translate(_SMALL)] += n
                for word, n in here.items():
                    word = change(key, word) if change else word
                    if len(word) >= min_length:
                        total[word] += n
            if len(total) >= COUNTED_AT_ONCE:
                yield told()
        yield told()

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class WaveletTree:
    """A permutation's values by bits, from the highest: at each level those with a 0 come before those with a 1, in order."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # how many zeros stand before each place
        now = values
        for b in range(self.bits - 1, -1, -1):
            one = (now >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            now = np.concatenate([now[~one], now[one]])

    def report(self, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """query, value: for each query all values v with low <= v < high that stand at the places from first to before last. All queries go down the levels together; branches without places or values in reach end there."""
        ask, value = np.arange(len(first)), np.zeros(len(first), np.int64)
        for level, zeros in enumerate(self.zeros):
            b = self.bits - 1 - level
            z0, z1 = zeros[first], zeros[last]
            left = (z1 > z0) & (value + (1 << b) > low[ask])
            one = value + (1 << b)
            right = (last - z1 > first - z0) & (one < high[ask])
            n = zeros[-1]
            ask, value, first, last = np.concatenate([ask[left], ask[right]]), np.concatenate([value[left], one[right]]), np.concatenate([z0[left], (first - z0)[right] + n]), np.concatenate([z1[left], (last - z1)[right] + n])
            near = (value < high[ask]) & (value + (1 << b) > low[ask])
            ask, value, first, last = ask[near], value[near], first[near], last[near]
        return ask, value


class _Order:
    """Rows in the order of their group and word (or word from its end), and the interval of points that share a beginning."""

    def __init__(self, codes: np.ndarray, group: np.ndarray, is_point: np.ndarray) -> None:
        n, width = codes.shape
        self.order = np.lexsort((np.ascontiguousarray(codes).view(f"<U{width}").ravel(), group))
        self.at = np.empty(n, np.int64)
        self.at[self.order] = np.arange(n)
        sorted_, g = codes[self.order], group[self.order]
        differs = sorted_[1:] != sorted_[:-1]
        common = np.where(differs.any(1), differs.argmax(1), width)
        self.common = np.where(g[1:] == g[:-1], common, -1)  # code points that a row shares with the one before
        self.points = np.concatenate([[0], np.cumsum(is_point[self.order])])

    def interval(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the first and the place after the last of the points, in this order, that share its group and first `depth` code points."""
        new = np.concatenate([[True], self.common < depth])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(new))
        run = (np.cumsum(new) - 1)[self.at]
        return self.points[begin][run], self.points[end][run]


def _near_in(words: list[str], group: np.ndarray, is_point: np.ndarray, target: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers a, b of near words in one group each: word b, a point of `target` code points, is a with its code point at one of the places low .. high - 1 replaced, or is a with one inserted there."""
    codes = np.array(words, dtype=f"<U{target}").view(np.uint32).reshape(len(words), target)
    # Read from its end: an inserting word, one shorter, has its unused place at the end here too.
    back = np.where(is_point[:, None], codes[:, ::-1], np.roll(codes[:, ::-1], -1, axis=1))
    forward, reverse = _Order(codes, group, is_point), _Order(np.ascontiguousarray(back), group, is_point)
    by_forward = forward.order[is_point[forward.order]]  # rows of the points in forward order
    by_reverse = reverse.order[is_point[reverse.order]]
    if not len(by_forward):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.empty(len(words), np.int64)
    rank[by_reverse] = np.arange(len(by_reverse))
    tree = WaveletTree(rank[by_forward])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    asked: list[tuple[np.ndarray, ...]] = []

    def ask() -> None:
        row, place, x0, x1, y0, y1 = (np.concatenate(c) for c in zip(*asked))
        asked.clear()
        query, value = tree.report(x0, x1, y0, y1)
        a, b, i = row[query], by_reverse[value], place[query]
        # A letter inserted beside its like gives one word at several places; the first of them counts.
        keep = np.where(is_point[a], a != b, (i == 0) | (codes[b, i] != codes[b, i - 1]))
        out.append((a[keep], b[keep]))

    waiting = 0
    for i in range(low, high):
        (x0, x1), (y0, y1) = forward.interval(i), reverse.interval(target - 1 - i)
        least = is_point.astype(np.int64)  # a point finds itself
        row = np.flatnonzero((x1 - x0 > least) & (y1 - y0 > least))
        if row.size:
            asked.append((row, np.full(row.size, i), x0[row], x1[row], y0[row], y1[row]))
            waiting += row.size
        if waiting >= ASKED_AT_ONCE:
            ask()
            waiting = 0
    if asked:
        ask()
    return np.concatenate([x[0] for x in out] or [np.zeros(0, np.int64)]), np.concatenate([x[1] for x in out] or [np.zeros(0, np.int64)])


def _told(words: list[str], n: np.ndarray, a: np.ndarray, b: np.ndarray, is_point: np.ndarray) -> pa.RecordBatch:
    """For each word with near words here: how many, and the one with the largest n, the first in code-point order of equal ones. A replaced letter is found from both sides, an inserted one from the shorter word alone."""
    one_way = ~is_point[a]
    a, b = np.concatenate([a, b[one_way]]), np.concatenate([b, a[one_way]])
    _, number = np.unique(np.array(words), return_inverse=True)
    order = np.lexsort((number[b], -n[b], number[a]))
    a, b = a[order], b[order]
    first = np.concatenate([[True], number[a][1:] != number[a][:-1]]) if len(a) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(a)))
    return pa.RecordBatch.from_arrays([pa.array([words[k] for k in a[at]], pa.string()), pa.array(count, pa.int64()), pa.array([words[k] for k in b[at]], pa.string()), pa.array(n[b[at]], pa.int64())], ["word", "n_near", "near", "near_n"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of whole groups that come in order; many small groups of one shape share a tree."""
    words: list[str] = []
    n: list[int] = []
    point: list[bool] = []
    group: list[int] = []
    shape = last = None

    def ready() -> Iterator[pa.RecordBatch]:
        if any(point) and len(words) > 1:
            is_point, counts = np.array(point), np.array(n, np.int64)
            a, b = _near_in(words, np.array(group), is_point, *shape)
            if len(a):
                yield _told(words, counts, a, b, is_point)
        for x in (words, n, point, group):
            x.clear()

    for batch in batches:
        for target, low, high, key, word, count, is_point in zip(*(c.to_pylist() for c in batch.columns)):
            now = (target, low, high)
            if (now, key) != last and (now != shape or len(words) >= TREE_ROWS or len(words) * target >= TREE_CELLS):
                yield from ready()
            group.append(group[-1] + ((now, key) != last) if group else 0)
            shape, last = now, (now, key)
            words.append(word)
            n.append(count)
            point.append(is_point)
    yield from ready()


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (target, low, high, word, ...) with the key of their group: what they must share if an edit at one of the places low .. high - 1 makes a word of `target` code points."""
    return rows.withColumn("key", F.concat(F.left("word", F.col("low")), F.lit(" "), F.right("word", F.col("target") - F.col("high"))))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near, near_n of words (word, n; one row each, of 2 code points or more) with near words: how many differ from it by one code point inserted, deleted or replaced, and the one of the largest n, ties to the smallest in code-point order, with its n.

    A word is a point in two orders, from its beginning and from its end. With
    an edit at place i the words near by share the first i code points, an
    interval of the forward order, and those behind the edit, an interval of
    the reverse order; a wavelet tree reports the points in both. Words of one
    length make the points, words of that length ask for replaced and words one
    shorter for inserted code points, so every point in a rectangle is near.

    On Spark an edit in the second half leaves the first half as it is, and one
    in the first half the second: words meet in groups by either half, so each
    moves four times. A group of more than GROUP_ROWS rows is split by where in
    its open part the edit is, and so on; words that share all but one place
    are no more than the alphabet, so no group stays large.
    """
    h = lambda n: F.floor(n / 2).cast("int")
    n = F.length("word")
    side = lambda target, low, high, point: F.struct(target.cast("int").alias("target"), low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(point).alias("is_point"))
    sides = F.array(side(n, h(n), n, True), side(n, F.lit(0), h(n), True), side(n + 1, h(n + 1), n + 1, False), side(n + 1, F.lit(0), h(n + 1), False))
    groups, keys = [], ["target", "low", "high", "key"]
    rows = _keyed(words.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.*"))
    while True:
        sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("m")).where((F.col("m") > GROUP_ROWS) & (F.col("high") - F.col("low") > 1)), "groups")
        large = sizes.agg(F.sum("m")).first()[0]
        if not large:
            groups.append(rows)
            drop_written(sizes)
            break
        marked = written(joined_apart(rows, sizes, keys, "m", large), "split")
        groups.append(marked.where("m IS NULL").drop("m"))
        middle = h(F.col("low") + F.col("high"))
        halves = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
        rows = _keyed(marked.where("m IS NOT NULL").select("word", "n", "target", "is_point", F.explode(halves).alias("s")).select("word", "n", "target", "is_point", "s.*"))
    found = []
    for part in groups:
        dealt = part.select(*keys, "word", "n", "is_point").repartition(*keys).sortWithinPartitions(*keys)
        found.append(dealt.mapInArrow(_search, _FOUND))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("b")
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "b.*")


def with_roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form; one row for each word that has a form, no circles): the end of the chain of forms. Each round doubles the steps taken, so rounds grow with the logarithm of the longest chain."""
    n = forms.count()
    left = written(forms.select("word", F.col("form").alias("root")), "chains", rows=n)
    while True:
        on = left.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(left.join(by_key(on), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains", rows=n)
        drop_written(left)
        left = moved
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")


def spelling_forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root string, n, n_near, form_n long of each of words (word, n).

    form: the near word (see near_words) of the largest n, if that is `ratio`
    (over 1) times the word's n or more, else null; form_n is its n. root: the
    last form of the chain of forms, the word itself without one. n_near is 0
    without near words. Words are never null nor repeated; no words, no rows.
    """
    if ratio < 2:
        raise ValueError("forms could go round in circles")
    words = written(words, "words")
    near = written(words.join(by_key(near_words(words)), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("near_n") >= ratio * F.col("n"), F.col("near")).alias("form"), F.when(F.col("near_n") >= ratio * F.col("n"), F.col("near_n")).alias("form_n")), "near")
    roots = with_roots(near.where("form IS NOT NULL").select("word", "form"))
    return near.join(by_key(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
