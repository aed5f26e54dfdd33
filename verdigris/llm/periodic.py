"""Periodic runs of words: stretches that repeat a block of words over and over."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import kept_in_worker, small_batches

#: A word is a stretch without ASCII white space.
WORD = re.compile("[^ \t-\r]+")
PRIME = np.uint64((1 << 31) - 1)
#: A search takes documents together up to so many words, and so many pairs at a time.
WORDS_AT_ONCE, PAIRS_AT_ONCE = 1 << 17, 1 << 19
_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, start long, length long, period long, collapsed string"

Reword = Callable[[int | None, list[str]], list[str]]


def _powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 .. n - 1, modulo PRIME, by doubling."""
    out, step = np.ones(1, np.uint64), base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % PRIME])
        step = step * step % int(PRIME)
    return out[:n]


class PrefixHashes:
    """Compares stretches of ids by hashes of prefixes: sums of id times power, so that two stretches p apart differ by the factor of power p."""

    def __init__(self, ids: np.ndarray, base: int) -> None:
        self.power = _powers(base, len(ids) + 1)
        terms = (ids.astype(np.uint64) + np.uint64(1)) % PRIME * self.power[:-1] % PRIME
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % PRIME])

    def same(self, at: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether ids[at : at + n] and the same stretch p later have one hash; where they have not, they differ."""
        here = (self.sums[at + n] + PRIME - self.sums[at]) % PRIME
        later = (self.sums[at + p + n] + PRIME - self.sums[at + p]) % PRIME
        return here * self.power[p] % PRIME == later

    def longest(self, at: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far the stretches from (back: up to) `at` and p later agree, by one binary search for all pairs at once."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) >> 1
            ok = self.same(at[open_] - mid if back else at[open_], p[open_], mid)
            low[open_[ok]] = mid[ok]
            high[open_[~ok]] = mid[~ok] - 1
        return low


def _pairs(sizes: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """document, period and grid point, in blocks: the points of period p are (times - 1) * p apart, so every run of `times` periods has one in its part that repeats."""
    doc = np.repeat(np.arange(len(sizes)), sizes // times)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(sizes // times) - sizes // times, sizes // times) + 1
    points = -((period - sizes[doc]) // ((times - 1) * period))
    total = np.cumsum(points)
    begin = 0
    while begin < len(doc):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS_AT_ONCE, "right")))
        k = points[begin:end]
        nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        p = np.repeat(period[begin:end], k)
        yield np.repeat(doc[begin:end], k), p, nth * (times - 1) * p
        begin = end


def _hashed_runs(ids: np.ndarray, bounds: np.ndarray, times: int, least: int, base: int) -> np.ndarray | None:
    """start, end, period of all runs of the documents ids[bounds[k] : bounds[k + 1]]; None if words disagree with their hashes."""
    hashes, found = PrefixHashes(ids, base), []
    for doc, p, point in _pairs(np.diff(bounds), times):
        first, last = bounds[doc], bounds[doc + 1]
        at = first + point
        hit = np.flatnonzero(ids[at] == ids[at + p])
        at, p, first, last = at[hit], p[hit], first[hit], last[hit]
        end = at + p + hashes.longest(at, p, last - at - p, False)
        start = at - hashes.longest(at, p, at - first, True)
        long = end - start >= np.maximum(least, times * p)
        found.append(np.stack([start[long], end[long], p[long]], 1))
    if not found:
        return np.zeros((0, 3), np.int64)
    found = np.unique(np.concatenate(found), axis=0)  # by start, end, period
    same = np.zeros(len(found), bool)
    same[1:] = (found[1:, :2] == found[:-1, :2]).all(1)
    runs = found[~same]  # of a stretch, the smallest period
    owner = np.cumsum(~same) - 1
    # Words, not hashes, decide: a stretch that has its smallest period also has that period's multiples.
    if (found[:, 2] % runs[owner, 2]).any() or not all((ids[s : e - p] == ids[s + p : e]).all() for s, e, p in runs):
        return None
    return runs


def find_in(words: list[list[str]], times: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each list of words, by start, then period.

    A run keeps its smallest period p over max(least, times * p) words or more
    and can't be longer. Harmonic grid: for every period p at most a `times`th
    of the list, points (times - 1) * p apart. For all pairs of a period and a
    point whose words agree at once, binary searches over prefix hashes tell how
    far the words before and behind agree with those p later. Runs found from
    several points or as multiples of a period are one; each is compared word by
    word, and should a hash have lied the search goes on with another base.
    """
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(ws) for ws in words], dtype=np.int64)]).astype(np.int64)
    base, runs = 48_271, None
    while runs is None:
        runs = _hashed_runs(ids, bounds, times, least, base)
        base = base * 69_621 % int(PRIME)
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for doc, (s, e, p) in zip(np.searchsorted(bounds, runs[:, 0], "right") - 1, runs.tolist()):
        out[doc].append((s - int(bounds[doc]), e - s, p))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | tuple[None, None, None]:
    """The run with the largest length by period, compared as whole numbers; the first of equal ones."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best or (None, None, None)


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words, one blank between, without those that some run holds behind its first period."""
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 4, least: int = 6, reword: Reword | None = None) -> DataFrame:
    """doc_id, n_words, runs, start, length, period, collapsed for each row of docs, its whole text read.

    runs: all runs (see find_in); start, length and period are those of the run
    with most periods, the first of equal ones, null without runs. collapsed:
    the text with each run's repeats left out. reword(id, words) may give other
    words to search. Null and empty texts have no words, no runs and an empty
    collapsed text; rows with null or repeated ids are each searched; other
    columns are left out. Nothing is shuffled: a document's work grows with
    n log n of its words, and documents are searched together in blocks.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    small_batches(docs.sparkSession)

    def search(ids: list, words: list[list[str]]) -> pa.RecordBatch:
        runs = find_in(words, times, least)
        best = [_strongest(r) for r in runs]
        places = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
        long = [pa.array([b[k] for b in best], pa.int64()) for k in range(3)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        texts = pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(places, kind), *long, texts], ["doc_id", "n_words", "runs", "start", "length", "period", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = kept_in_worker(("runs", WORD.pattern), lambda: WORD.findall)
        for batch in batches:
            ids, words, n = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = split(text.as_py() or "")
                ids.append(key)
                words.append(reword(key, found) if reword else found)
                n += len(found)
                if n >= WORDS_AT_ONCE:
                    yield search(ids, words)
                    ids, words, n = [], [], 0
            if ids:
                yield search(ids, words)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCHEMA)
