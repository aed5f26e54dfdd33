"""Line dedup by pairwise alignment.

1. Texts are cut into lines: at line breaks, after full stops, question and
   exclamation marks, and after each word whose last bytes hash to one value in
   CUT (so that a passage has the same lines wherever it begins or ends within a
   sentence). At each line the shortest run of lines that reaches `min_words`
   words gets a hash of its own, and so does each stretch of at least
   `line_words` words that a document has between two line breaks.
2. A hash that only one document has makes no pair (rarity decides: a hash in m
   documents makes m - 1 pairs, not m squared, so frequent ones need no cap).
   The owner of a hash is the earliest document that has it, and a later
   document pairs with the owners of its hashes.
3. A pair is aligned by patience diff: lines unique on both sides, their
   longest common order, then the stretches between. Aligned blocks of at least
   `block_words` words go from the later document. What is left is aligned
   again, PASSES times at most, which finds passages in another order. Lines
   that patience cannot tell apart are compared last, by an index of the
   earlier document's runs. All of it is linear in the pair's lines, but for
   the sorting.

So every such run, and every whole line of at least `line_words` words, that an
earlier document has goes from a later one. Shorter stretches stay, the last
lines of a longer one too, unless the pair that shares them has another hash
in common whose owner the earlier document is. The lines of an owner are copied over salts by the number of
documents that its most frequent hash has, so an owner's pairs do not meet in
one task.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import by_hash, by_key, drop_written, fresh, small_batches, written

#: Words of a run that makes a pair; of a whole line that does; of a block that goes from a pair.
MIN_WORDS, LINE_WORDS, BLOCK_WORDS = 20, 8, 8
CUT, PASSES, DEPTH = 8, 4, 32
#: Pairs of one owner in a salt.
SALT_ROWS = 10_000
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def lines_at(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a UTF-8 text: the byte at which each line begins and the one after its last word, its number of words, and whether a line break stands before it (or it is the first)."""
    b = np.frombuffer(data, np.uint8)
    space = np.ones(len(b) + 2, bool)
    space[1:-1] = _SPACE[b]
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return starts, ends, starts, np.zeros(0, bool)
    last = b[ends - 1]
    tail = last.astype(np.uint32)
    for k in (2, 3):  # the last three bytes, those of the word alone
        tail = tail * np.uint32(257) + np.where(ends - k >= starts, b[ends - k], 0)
    cut = _STOP[last] | ((tail * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(CUT) == 0)
    broken = np.zeros(len(starts), bool)
    broken[np.searchsorted(starts, np.flatnonzero(b == 10)) % len(starts)] = True
    broken[0] = True
    begins = broken.copy()
    begins[1:] |= cut[:-1]
    first = np.flatnonzero(begins)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1], np.diff(np.append(first, len(starts))), broken[first]


def hashed_lines(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of words and whether it follows a line break, of each line of all texts, and where each text's lines begin (and the last one's end). White space at a line's end doesn't count."""
    datas = [(t or "").encode() for t in texts]
    data = b"\n".join(datas)
    starts, ends, words, broken = lines_at(data)
    of = xxhash.xxh3_64_intdigest
    hashes = np.array([of(data[i:j]) for i, j in zip(starts.tolist(), ends.tolist())], np.uint64)
    begins = np.cumsum([0, *(len(d) + 1 for d in datas)])
    return hashes.view(np.int64), words, broken, np.searchsorted(starts, begins)


def portions(texts: list[str | None], most: int = 1 << 21) -> Iterator[list[str | None]]:
    """The texts in portions of about `most` characters, a longer one alone."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t or "") > most:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t or "")
    if out:
        yield out


def runs_of(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shortest stretches [i, end) of at least `min_words` words, from each line that has one."""
    upto = np.append(0, np.cumsum(words))
    ends = np.searchsorted(upto, upto[:-1] + min_words)
    some = np.flatnonzero(ends <= len(words))
    return some, ends[some]


def whole_lines(words: np.ndarray, broken: np.ndarray, line_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches between line breaks of at least `line_words` words."""
    edges = np.append(np.flatnonzero(broken), len(broken))
    upto = np.append(0, np.cumsum(words))[edges]
    some = np.flatnonzero(np.diff(upto) >= line_words)
    return edges[some], edges[some + 1]


def stretch_hashes(hashes: np.ndarray, at: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each stretch, from a polynomial in its lines' hashes."""
    n = len(hashes)
    grow, shrink = np.full(n + 1, _ODD), np.full(n + 1, _INVERSE)
    grow[0] = shrink[0] = 1
    grow, shrink = np.cumprod(grow), np.cumprod(shrink)
    upto = np.zeros(n + 1, np.uint64)
    upto[1:] = np.cumsum(hashes.view(np.uint64) * grow[:-1])
    out = (upto[ends] - upto[at]) * shrink[at] + (ends - at).astype(np.uint64) * np.uint64(2 * seed + 1)
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def run_hashes(hashes: np.ndarray, words: np.ndarray, broken: np.ndarray, places: np.ndarray, min_words: int, line_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, in each text, of runs_of and, kept apart from these, of whole_lines; and where each text's begin (and the last one's end)."""
    at, ends = runs_of(words, min_words)
    text = np.repeat(np.arange(len(places) - 1), np.diff(places))
    inside = ends <= places[text[at] + 1]
    at, ends = at[inside], ends[inside]
    line_at, line_ends = whole_lines(words, broken, line_words)
    found = np.concatenate([stretch_hashes(hashes, at, ends, 0), stretch_hashes(hashes, line_at, line_ends, 1)])
    text = text[np.concatenate([at, line_at])]
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[new], np.searchsorted(text[new], np.arange(len(places)))


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs (by first) whose seconds rise: patience sorting."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tops, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j), both rising, with a[i] == b[j]. Stretches are split DEPTH times at most."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), 0)]
    while todo:
        i, i_end, j, j_end, depth = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end or depth == DEPTH:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        where = {x: k for k, x in enumerate(b[j:j_end], j) if in_b[x] == 1}
        anchors = _rising([(k, where[x]) for k, x in enumerate(a[i:i_end], i) if in_a[x] == 1 and x in where])
        for p, q in zip([(i - 1, j - 1), *anchors], [*anchors, (i_end, j_end)]):
            if anchors:
                todo.append((p[0] + 1, q[0], p[1] + 1, q[1], depth + 1))
        out += anchors
    return sorted(out)


def aligned_blocks(later: np.ndarray, words: np.ndarray, broken: np.ndarray, earlier: np.ndarray, earlier_broken: np.ndarray, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS, block_words: int = BLOCK_WORDS) -> np.ndarray:
    """Positions in `later` of the lines that an aligned block, a run or a whole line of `earlier` holds."""
    own, there = later.tolist(), earlier.tolist()
    both = set(there).intersection(own)
    common = [i for i, h in enumerate(own) if h in both]
    at = [j for j, h in enumerate(there) if h in both]
    there = [there[j] for j in at]
    size, rest, gone = words.tolist(), common, set()
    for _ in range(PASSES):
        pairs = patience([own[i] for i in rest], there)
        found: list[int] = []
        k = 0
        while k < len(pairs):
            i, j = rest[pairs[k][0]], at[pairs[k][1]]
            total, e = size[i], k + 1
            # a block ends where either side leaves lines out
            while e < len(pairs) and rest[pairs[e][0]] - i == e - k == at[pairs[e][1]] - j:
                total += size[rest[pairs[e][0]]]
                e += 1
            if total >= block_words:
                found += range(i, i + e - k)
            k = e
        if not found:
            break
        gone.update(found)
        rest = [i for i in rest if i not in gone]
    # What else is shared is a stretch of common lines that holds one of the rest.
    least, k, more = min(min_words, line_words), 0, False
    while rest and k < len(common) and not more:
        e, total = k + 1, size[common[k]]
        while e < len(common) and common[e] == common[e - 1] + 1:
            total += size[common[e]]
            e += 1
        more = total >= least and not gone.issuperset(common[k:e])
        k = e
    if not more:
        return np.array(sorted(gone), np.int64)
    taken = np.zeros(len(later), bool)
    taken[list(gone)] = True
    # Patience needs lines that are unique and in order; what else is shared is found by the hashes of the earlier document's stretches.
    order = np.argsort(later, kind="stable")
    nearest = order[np.minimum(np.searchsorted(later[order], earlier), len(later) - 1)]
    # lines that `later` lacks end any stretch, so they may count as one that is long enough alone
    known = np.where(later[nearest] == earlier, words[nearest], max(min_words, line_words))
    cover = np.zeros(len(later) + 1, int)
    for seed, mine, other in ((0, runs_of(words, min_words), runs_of(known, min_words)), (1, whole_lines(words, broken, line_words), whole_lines(known, earlier_broken, line_words))):
        same = np.isin(stretch_hashes(later, *mine, seed), stretch_hashes(earlier, *other, seed))
        np.add.at(cover, mine[0][same], 1)
        np.add.at(cover, mine[1][same], -1)
    return np.flatnonzero(taken | (np.cumsum(cover)[:-1] > 0))


def _values(row: pa.ListScalar) -> np.ndarray:
    return row.values.to_numpy(zero_copy_only=False)


def _lists(rows: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(kind) if rows else np.zeros(0, kind)))


def without(text: str, gone: list[int]) -> str:
    """The text without these of its lines; empty if none is left."""
    data = text.encode()
    starts = lines_at(data)[0]
    if len(set(gone)) >= len(starts):
        return ""
    edges, out, at = [*starts.tolist(), len(data)], [], 0
    for k in sorted(gone):
        out.append(data[at : edges[k]])
        at = edges[k + 1]
    return b"".join([*out, data[at:]]).decode()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, line_words: int = LINE_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with what is shared taken out of each later document's text, and lines_removed int.

    Earlier means a smaller id. Rows with the same id and text are one
    document and share a result; of rows with one id and different texts, the
    one with the smaller text hash is earlier. Rows whose id or text is null
    stay as they are and own nothing. A text that goes whole becomes empty.
    Other columns stay; one named lines_removed is replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lines_removed")
    th, own_id, own_th, gone_col = (fresh(docs, x) for x in ("_th", "_id", "_mth", "_gone"))
    keyed = docs.withColumn(th, F.xxhash64(text_col))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in portions(b.column(2).to_pylist()):
                hashes, words, broken, places = hashed_lines(texts)
                runs, runs_at = run_hashes(hashes, words, broken, places, min_words, line_words)
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(kind))) for flat, ends, kind in ((hashes, places, np.int64), (words, places, np.int32), (broken, places, bool), (runs, runs_at, np.int64))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), *lists], ["id", "th", "hashes", "words", "broken", "runs"])
                at += len(texts)

    source = keyed.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(th).alias("th"), text_col)
    lines = written(source.mapInArrow(scan, "id long, th long, hashes array<long>, words array<int>, broken array<boolean>, runs array<long>"), "lines")
    # Most hashes stand once: they are counted alone, before any document is named.
    often = written(lines.select(F.explode("runs").alias("run")).groupBy("run").agg(F.count("*").alias("m")).where("m > 1"), "often")
    hits = written(lines.select("id", "th", F.explode("runs").alias("run")).join(by_hash(often), "run"), "hits")
    doc = F.struct("id", "th")
    owners = written(hits.groupBy("run").agg(F.min(doc).alias("own"), F.max(doc).alias("last")).where("own <> last").select("run", "own"), "owners")
    salts = lambda m: F.ceil(F.col(m) / SALT_ROWS).cast("int")
    pairs = hits.join(by_key(owners), "run").where(F.col("own") < doc).groupBy("id", "th", F.col("own.id").alias("o_id"), F.col("own.th").alias("o_th")).agg(F.max("m").alias("m"))
    pairs = written(pairs.withColumn("salt", F.pmod(F.xxhash64("id", "th"), salts("m")).cast("int")), "pairs")
    later = lines.select("id", "th", "hashes", "words", "broken").dropDuplicates(["id", "th"])
    wanted = pairs.groupBy("o_id", "o_th").agg(F.max("m").alias("m"))
    owned = lines.select(F.col("id").alias("o_id"), F.col("th").alias("o_th"), F.col("hashes").alias("o_hashes"), F.col("broken").alias("o_broken")).join(by_key(wanted), ["o_id", "o_th"]).dropDuplicates(["o_id", "o_th"])
    earlier = written(owned.withColumn("salt", F.explode(F.sequence(F.lit(0), salts("m") - 1))).drop("m"), "earlier")
    both = pairs.drop("m").join(by_key(later), ["id", "th"]).join(by_key(earlier), ["o_id", "o_th", "salt"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [aligned_blocks(*row, min_words, line_words, block_words) for row in zip(*(map(_values, b.column(k)) for k in ("hashes", "words", "broken", "o_hashes", "o_broken")))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), _lists(out, np.int32)], ["id", "th", "gone"])

    gone = both.mapInArrow(align, "id long, th long, gone array<int>").groupBy(F.col("id").alias(own_id), F.col("th").alias(own_th)).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias(gone_col))
    gone = written(gone.where(F.size(gone_col) > 0), "gone")
    drop_written(lines, often, hits, owners, pairs, earlier)
    joined = keyed.join(by_key(gone), (F.col(id_col).cast("long") == F.col(own_id)) & (F.col(th) == F.col(own_th)), "left").select(*docs.columns, gone_col)
    at, removed = docs.columns.index(text_col), "lines_removed"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, text = b.column(len(docs_columns)), b.column(at)
            some = pc.is_valid(gone)
            left = pa.array([without(t, g) for t, g in zip(text.filter(some).to_pylist(), gone.filter(some).to_pylist())], text.type)
            n = pc.fill_null(pc.list_value_length(gone), 0).cast(pa.int32())
            columns = [pc.replace_with_mask(text, some, left) if k == at else b.column(k) for k in range(len(docs_columns))]
            yield pa.RecordBatch.from_arrays([*columns, n], [*docs_columns, removed])

    docs_columns = docs.columns
    return joined.mapInArrow(cut, docs.select("*").schema.add(removed, "integer"))
