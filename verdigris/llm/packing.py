"""Best-fit packing of tokenised documents by a linear grouping scheme.

Lengths above `small_max` are sorted and dealt into groups of equal
cardinality, each rounded up to its longest member. For these few sizes,
configurations (which sizes share a sequence) are built one after another by
a subset-sum that fills a sequence around the largest size left, each used as
often as its sizes last. The documents themselves then take the slots, and the
small ones go best-fit into the room that is left.

The plan needs only the histogram of lengths: at most `capacity` counts,
whatever the corpus. It is a list of runs "ranks r0.. of length l go to
sequences s0.., k in each, from offset o"; a document finds its place from
its length and its rank among documents of this length, so nothing but the
histogram reaches the driver and no group meets in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import by_key, kept_in_worker, small_batches, written

CAPACITY, END_ID, TOKENIZER = 4096, 1, "word_bpe_49k.json"
#: Numbers of groups that are planned; the plan of the fewest sequences holds.
GROUPS = (64, 128)
#: A plan goes to every worker. It has a few runs for each length and group, so fewer groups make a smaller one.
PLAN_ROWS = 1_000_000


class _Kept(dict):
    """Computed values by key; those of the last full generation come back without being computed again."""

    def __init__(self, make, old: dict):
        self.make, self.old = make, old

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit numbers, equal to the tokenizer's own.

    The tokenizer drops white space and splits there, so blank-separated words
    can be encoded one at a time and kept. Words of Latin letters, perhaps with
    full stops or commas behind, go straight to the BPE model; any other word
    takes the tokenizer's whole way. Words and their letters are kept, at most
    about `most` of each in two generations.
    """

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.tokenize, self.most = self.whole.model.tokenize, most
        self.packed = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        # the usual printable stand-ins for bytes in byte-level BPE
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.stand_in = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
        self.words, self.cores = _Kept(self._word, {}), _Kept(self._core, {})

    def _other(self, word: str) -> bytes:
        return b"".join([self.packed[i] for i in self.whole.encode(word, add_special_tokens=False).ids])

    def _core(self, core: str) -> bytes:
        """core: lower-case Latin letters."""
        shown = core if core.isascii() else "".join([self.stand_in[b] for b in core.encode()])
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        core = word.rstrip(".,")
        if not core.isalpha() or not (core.isascii() or max(core) <= "\xff"):
            return self._other(word) if word else b""
        ids = self.cores[core.lower()]
        return ids + self.words[word[len(core) :]] if len(core) < len(word) else ids

    def encode(self, text: str) -> bytes:
        if len(self.words) > self.most:
            self.words = _Kept(self._word, dict(self.words))
        if len(self.cores) > self.most:
            self.cores = _Kept(self._core, dict(self.cores))
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece of each document, with its rank in (part, length).

    Null text counts as empty; a document has at least the end id. tokenizer:
    a file's path, by default that of TOKENIZER as installed on the worker.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = tokenizer
        if file is None:
            import public_tokenizers

            file = public_tokenizers.path(TOKENIZER)
        encoder = kept_in_worker(("WordEncoder", file), lambda: WordEncoder(file))
        part, seen, end = TaskContext.get().partitionId(), {}, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(own), part, seen.get(n, 0)))
                    seen[n] = seen.get(n, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "idx"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, idx long")


def _fill(sizes: list[int], left: list[int], room: int) -> dict[int, int]:
    """How many of each size (by index) fill `room` best, at most left[i] of each."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    by, times = np.full(room + 1, -1), np.zeros(room + 1, int)
    for i, size in enumerate(sizes):
        if not left[i] or size > room:
            continue
        before = reach.copy()
        for k in range(1, min(left[i], room // size) + 1):
            new = np.zeros(room + 1, bool)
            new[k * size :] = before[: room + 1 - k * size]
            new &= ~reach
            by[new], times[new] = i, k
            reach |= new
        if reach[room]:
            break
    at, out = int(np.flatnonzero(reach)[-1]), {}
    while at:
        i, k = int(by[at]), int(times[at])
        out[i] = k
        at -= k * sizes[i]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 64, small_max: int | None = None) -> tuple[np.ndarray, int]:
    """Runs (length, rank0, sequence0, per_sequence, offset) sorted by length and rank0, and the number of sequences."""
    small_max = capacity // 8 if small_max is None else small_max
    runs: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, count)
    ordered: list[int] = []
    n_seq = 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in rooms:
                bisect.insort(ordered, room)
                rooms[room] = []
            rooms[room].append((first, count))

    if full := histogram.get(capacity, 0):
        runs.append((capacity, 0, 0, 1, 0))
        n_seq = full
    # Linear grouping: by falling length, groups of equal cardinality.
    large = [(l, histogram[l]) for l in sorted(histogram, reverse=True) if small_max < l < capacity and histogram[l]]
    total = sum(c for _, c in large)
    each = max(1, -(-total // groups))
    members: list[list[tuple[int, int, int]]] = []  # a group's (length, rank0, count)
    room_in = 0
    for l, c in large:
        rank = 0
        while rank < c:
            if not room_in:
                members.append([])
                room_in = each
            n = min(room_in, c - rank)
            members[-1].append((l, rank, n))
            rank, room_in = rank + n, room_in - n
    sizes, left = [m[0][0] for m in members], [sum(x[2] for x in m) for m in members]
    at = [[0, 0] for _ in members]  # the next slot taker of each group: member, place in it

    top = 0
    while top < len(sizes):
        if not left[top]:
            top += 1
            continue
        spare = left.copy()
        spare[top] -= 1
        config = _fill(sizes, spare, capacity - sizes[top])
        config[top] = config.get(top, 0) + 1
        times = min(left[g] // k for g, k in config.items())
        slots = [g for g, k in sorted(config.items()) for _ in range(k)]
        done = 0
        while done < times:  # sequences whose slots hold the same lengths make one run
            n = times - done
            while True:
                state, drawn = [x.copy() for x in at], []
                for g in slots:
                    l, rank, count = members[g][state[g][0]]
                    have = count - state[g][1]
                    if have < n:
                        break
                    drawn.append((l, rank + state[g][1]))
                    state[g] = [state[g][0] + 1, 0] if have == n else [state[g][0], state[g][1] + n]
                else:
                    break
                n = have
            at, offset = state, 0
            for l, rank in drawn:
                runs.append((l, rank, n_seq, 1, offset))
                offset += l
            put(capacity - offset, n_seq, n)
            n_seq, done = n_seq + n, done + n
        for g, k in config.items():
            left[g] -= k * times
    # Best fit: each small length, longest first, into the tightest room.
    for l in sorted((x for x in histogram if x <= small_max and x < capacity), reverse=True):
        rank, c = 0, histogram[l]
        while c:
            i = bisect.bisect_left(ordered, l)
            if i == len(ordered):
                per = capacity // l
                count = max(1, c // per)
                put(capacity, n_seq, count)
                n_seq += count
                continue
            room = ordered[i]
            first, count = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], ordered[i]
            per = room // l
            whole = min(count, c // per)
            if whole:
                used = whole * per
                runs.append((l, rank, first, per, capacity - room))
                put(room - per * l, first, whole)
                put(room, first + whole, count - whole)
            else:
                used = c
                runs.append((l, rank, first, c, capacity - room))
                put(room - c * l, first, 1)
                put(room, first + 1, count - 1)
            rank, c = rank + used, c - used
    return np.array(sorted(runs), np.int64).reshape(-1, 5), n_seq


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> tuple[np.ndarray, int]:
    """The plan of the fewest sequences among those of these numbers of groups that have at most PLAN_ROWS runs; if none has, of half the groups, down to one."""
    fitting = [p for g in groups for p in [plan(histogram, capacity, g)] if len(p[0]) <= PLAN_ROWS or g == 1]
    return min(fitting, key=lambda p: p[1]) if fitting else best_plan(histogram, capacity, (max(1, min(groups) // 2),))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (a written table of token_pieces)."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = written(counts, "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_plan(histogram, capacity)
    keys = runs[:, 0] * (1 << 50) + runs[:, 1]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(by_key(starts), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("idx")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            own = runs[np.searchsorted(keys, length * (1 << 50) + rank, "right") - 1]
            nth = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(own[:, 2] + nth // own[:, 3]), pa.array(own[:, 4] + nth % own[:, 3] * length)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Packs every document into sequences of at most `capacity` tokens.

    Null and empty texts hold the end id alone; only documents longer than
    `capacity` are cut, into pieces of `capacity` (the last may be shorter).
    Repeated rows are packed once for each row. An empty table gives no rows.
    Other columns of docs are left out; join on doc_id to get them back.
    """
    return place(written(token_pieces(docs, id_col, text_col, capacity, end_id, tokenizer), "pieces"), capacity)
