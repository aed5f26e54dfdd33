"""N-gram Jaccard join by prefix filters under several global orders.

A document is its set of word shingles (64-bit hashes). If two sets reach the
Jaccard threshold, they share a token among the first n - ceil(t n) + 1 of each
under *any* order of all tokens. Three orders are used, each of them settled by
a document's early tokens, those whose hash lies under a fixed bound that takes
EARLY times as many tokens as a prefix needs:

* by document frequency: early tokens come first, rare before frequent, then
  the others by hash. Tokens of one set alone use up the prefix, so what
  remains is a short list of tokens by which documents meet. Only early tokens
  are counted and only they move, a quarter of all for the usual threshold;
* by hash, and by a second hash: the pairs that the first order offers must
  share a token in both of these prefixes too. Only early tokens are compared
  for it, and a pair whose early tokens leave no room for the overlap goes as
  well. The other tokens move for the pairs alone that all three orders keep.

Documents of equal sets are one node. The result is components, so pairs inside
a known component need no test: a first round compares each node with one hub,
that of most of its prefix tokens, which joins a group of m near copies by at
most m - 1 pairs. Then pairs of nodes in different components are compared that
share a prefix token at places which leave room for the whole overlap, and
whose parity sketches do not differ in more bits than linked sets differ in
tokens: first a hashed part of them, which joins most of what is left of large
groups, then all others. A token's nodes meet in blocks of BLOCK. Nothing is
capped, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import by_hash, by_key, drop_written, fresh, kept_in_worker, linked_components, small_batches, written

BLOCK, SKETCH_BITS, EARLY = 256, 512, 1.6
#: After the hubs, rounds over this part of all pairs, and over the other pairs.
#: The part joins most of a large group, whose inner pairs then need no test.
PART = 16
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct shingle hashes of a text; words are kept hashed, at most `most` of them."""

    def __init__(self, k: int, most: int = 300_000):
        self.k, self.most, self.known = k, most, {}

    def tokens(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(_UPPER).split()  # bytes split at ASCII white space alone
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = out * _ODD + h[i : len(h) - k + 1 + i]
        return np.unique(_mixed(out))


class Threshold:
    """Jaccard >= num / den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n: int) -> int:
        """The smallest overlap and the smallest partner of a set of n."""
        return -(-self.num * n // self.den)

    def spare(self, n: int) -> int:
        return n - self.least(n)

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def early(self) -> int:
        """Tokens under this hash are early; an even number."""
        return min(int(EARLY * (self.den - self.num) / self.den * (1 << 64)), (1 << 64) - 2) & ~1


def _node(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def _sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens that fall on each of SKETCH_BITS bits: two sets differ in at least as many tokens as sketches in bits."""
    return np.packbits((np.bincount((tokens >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _values(column: pa.Array) -> list[np.ndarray]:
    return [v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in column]


def _meet(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _in_all_orders(x: np.ndarray, y: np.ndarray, px: int, py: int) -> bool:
    """Whether prefixes of px and py tokens of two sets meet by hash and by a second hash. x, y: their early tokens, by hash."""
    if len(x) < px or len(y) < py:  # a prefix reaches beyond the early tokens: nothing is known
        return True
    if not _meet(x[:px], y[:py]):
        return False
    u, v = _mixed(x * _ODD), _mixed(y * _ODD)
    return _meet(np.partition(u, px - 1)[:px], np.partition(v, py - 1)[:py]) > 0


def _verify(sets: DataFrame, pairs: DataFrame, rule: Threshold) -> DataFrame:
    """Those of pairs (a, b, ca, cb) that link. The late tokens of the sets move only for pairs that all orders keep."""
    side = lambda x, part: sets.select(F.col("node").alias(x), *([F.col("n").alias(f"n_{x}")] if part == "early" else []), F.col(part).alias(f"t_{x}"))
    met = lambda pairs, part: pairs.join(by_key(side("a", part)), "a").join(by_key(side("b", part)), "b")
    names = ["a", "b", "ca", "cb"]

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, seen = [], []
            for n, m, x, y in zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), _values(batch.column("t_a")), _values(batch.column("t_b"))):
                ok = m >= rule.least(n) and n >= rule.least(m) and _in_all_orders(x, y, rule.spare(n) + 1, rule.spare(m) + 1)
                overlap = _meet(x, y) if ok else 0
                keep.append(ok and rule.linked(overlap + min(n - len(x), m - len(y)), n, m))
                seen.append(overlap)
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(kept) for c in [*names, "n_a", "n_b"]), pa.array(seen, pa.int64()).filter(kept)], [*names, "n_a", "n_b", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "seen")), _values(batch.column("t_a")), _values(batch.column("t_b")))
            kept = pa.array([rule.linked(seen + _meet(x, y), n, m) for n, m, seen, x, y in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in names], names)

    ids = "a long, b long, ca long, cb long"
    return met(met(pairs, "early").mapInArrow(filters, f"{ids}, n_a long, n_b long, seen long"), "late").mapInArrow(run, ids)


def _columns(lists: pa.ListArray) -> list[np.ndarray]:
    """node, n, component, pos and sketch of all members in the lists."""
    members = lists.flatten()
    sketch = np.frombuffer(b"".join(members.field(4).to_pylist()), np.uint64).reshape(len(members), -1)
    return [*(members.field(k).to_numpy(zero_copy_only=False) for k in range(4)), sketch]


def _products(sizes: np.ndarray, others: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in two flat columns of lists: every member of each list with every one of its other list, about `most` pairs at a time."""
    rows = np.repeat(np.arange(len(sizes)), sizes)  # a row for each member of the first lists
    each = others[rows]
    first = (np.cumsum(others) - others)[rows]
    upto = np.cumsum(each)
    for s in np.flatnonzero(np.diff(upto // most, prepend=-1)) if len(each) else ():
        e = np.searchsorted(upto, (upto[s] // most + 1) * most)
        at = np.arange(s, min(e, len(each)))
        i = np.repeat(at, each[at])
        nth = np.arange(len(i)) - np.repeat(np.cumsum(each[at]) - each[at], each[at])
        yield i, first[i] + nth


def _residual(members: DataFrame, rule: Threshold, first: bool) -> DataFrame:
    """Pairs a < b, and their components, of one token's members (token, node, n, pos, component, sketch, m) in different components whose places of the token and sketches leave room for a link: the PART-th of them that their hash picks first, or all others."""
    blocked = members.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    lists = written(blocked.groupBy("token", "blocks", "block").agg(F.collect_list(F.struct("node", "n", "component", "pos", "sketch")).alias("of")), "blocks")
    # Most tokens have one block, which needs no join to meet itself.
    parts = lists.where("blocks > 1")
    mates = parts.withColumn("other", F.explode(F.sequence("block", F.col("blocks") - 1)))
    both = mates.join(by_key(parts.select("token", F.col("block").alias("other"), F.col("of").alias("with"))), ["token", "other"]).select("of", "with")
    both = both.unionByName(lists.where("blocks = 1").select("of", F.col("of").alias("with")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, na, ca, pa_, sa), (b, nb, cb, pb, sb) = (_columns(batch.column(k)) for k in ("of", "with"))
            sizes, others = (pc.list_value_length(batch.column(k)).to_numpy() for k in ("of", "with"))
            for i, j in _products(sizes, others):
                # the first token in common passes: what follows it on either side must hold the whole overlap
                room, both_n = np.minimum(na[i] - pa_[i], nb[j] - pb[j]), na[i] + nb[j]
                fits = (ca[i] != cb[j]) & ((rule.den + rule.num) * room >= rule.num * both_n)
                fits &= (_mixed((a[i] ^ b[j]).view(np.uint64) * _ODD) % np.uint64(PART) == 0) == first
                i, j, both_n = i[fits], j[fits], both_n[fits]
                differ = np.bitwise_count(sa[i] ^ sb[j]).sum(1, dtype=np.int64)
                fits = (rule.den + rule.num) * differ <= (rule.den - rule.num) * both_n
                i, j = i[fits], j[fits]
                less = a[i] < b[j]
                out = np.unique(np.stack([np.where(less, a[i], b[j]), np.where(less, b[j], a[i]), np.where(less, ca[i], cb[j]), np.where(less, cb[j], ca[i])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["a", "b", "ca", "cb"])

    return both.mapInArrow(run, "a long, b long, ca long, cb long").distinct()


def _groups(members: DataFrame) -> DataFrame:
    """token, hub, m of the tokens whose members (token, node, component) lie in different components."""
    ends = members.groupBy("token").agg(F.min_by("node", F.xxhash64("node")).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"))
    return ends.where("low <> high").select("token", "hub", "m")


def _relabelled(labels: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """labels (node, component), rows of them, after links between components (ca, cb)."""
    joined = linked_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    if joined is None:
        return labels
    into = joined.select(F.col("id").alias("component"), F.col("component").alias("into"))
    return written(labels.join(by_key(into), "component", "left").select("node", F.coalesce("into", "component").alias("component")), "labels", rows=rows)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, num: int = 85, den: int = 100, with_text_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles long, component_id long for each row of docs; with_text_hash: text_hash long too, Spark's xxhash64 of the row's text.

    ASCII capitals count as lower case, words end at ASCII white space. A text
    with fewer than `words` words has one shingle, the whole; one without
    words (null, empty) has none, links with nothing and is its own component.
    component_id is the smallest id that links reach, ids of equal sets
    included; rows with a null id share their component's smallest id, or null.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rule = Threshold(num, den)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Where a text is read again: its id, or for a null id its hash. An id equal to a hash only reads one text more.
    source = source.withColumn("place", F.coalesce("id", F.xxhash64("text")))

    hashed = ["text_hash"] if with_text_hash else []
    if with_text_hash:
        source = source.withColumn("text_hash", F.xxhash64("text"))
    early = rule.early()
    lists = "array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = kept_in_worker(("Shingler", words), lambda: Shingler(words)), set()
        for batch in batches:
            n, under, nodes, told = [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = shingler.tokens(text)
                node = _node(tokens) if len(tokens) else None
                n.append(len(tokens))
                under.append(int(np.searchsorted(tokens, np.uint64(early))))
                nodes.append(node)
                # what settles a set's prefixes is told once in a task, however many copies it has there
                told.append(tokens[: max(under[-1], rule.spare(len(tokens)) + 1) if len(tokens) and node not in seen else 0])
                seen.add(node)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("place"), pa.array(n, pa.int64()), pa.array(under, pa.int64()), pa.array(nodes, pa.int64()), _lists(told), *[batch.column(c) for c in hashed]], ["id", "place", "n", "under", "node", "told", *hashed])

    scanned = written(source.mapInArrow(scan, f"id long, place long, n long, under long, node long, told {lists}" + "".join(f", {c} long" for c in hashed)), "scanned")
    nodes = written(scanned.where("n > 0").groupBy("node").agg(F.min("id").alias("first_id"), F.min("place").alias("place"), F.max("n").alias("n"), F.max("under").alias("under"), F.max(F.size("told")).alias("n_told")), "nodes")

    # By document frequency. Several tasks may have told a node's tokens: that changes the order, not that there is one.
    told = scanned.where("size(told) > 0").select("node", F.explode("told").alias("token"))
    df = written(told.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("df")).where("low <> high").select("token", "df"), "df")
    late = F.shiftrightunsigned("token", 1) >= F.lit(early >> 1)
    shared = told.join(by_hash(df), "token").groupBy("node").agg(F.sort_array(F.collect_set(F.struct(late.alias("late"), "df", "token"))).alias("by_df")).join(by_key(nodes), "node")
    n_late = F.size(F.filter("by_df", lambda x: x["late"]))
    alone = F.col("under") - (F.size("by_df") - n_late)
    late_alone = F.col("n_told") - F.col("under") - n_late
    spare = F.col("n") - F.ceil(F.col("n") * num / den)
    kept = F.slice("by_df", F.lit(1), F.greatest(spare + 1 - alone, F.lit(0)).cast("int"))
    met = shared.select("node", "n", spare.alias("spare"), alone.alias("alone"), late_alone.alias("late_alone"), F.posexplode(kept).alias("nth", "x"))
    met = met.select("node", "n", "spare", F.col("x.token").alias("token"), (F.col("alone") + F.col("nth") + F.when(F.col("x.late"), F.col("late_alone")).otherwise(0)).alias("pos")).where("pos <= spare").drop("spare")
    met = written(met, "met")
    drop_written(df)
    groups = written(_groups(met.withColumn("component", F.col("node"))), "groups")
    members = written(met.join(by_key(groups), "token"), "members")
    drop_written(met)

    # Whole sets of the members only, one document for each node.
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = kept_in_worker(("Shingler", words), lambda: Shingler(words))
        for batch in batches:
            tokens = [shingler.tokens(t) for t in batch.column("text").to_pylist()]
            cuts = [int(np.searchsorted(t, np.uint64(early))) for t in tokens]
            yield pa.RecordBatch.from_arrays([pa.array([_node(t) for t in tokens], pa.int64()), pa.array([len(t) for t in tokens], pa.int64()), _lists([t[:c] for t, c in zip(tokens, cuts)]), _lists([t[c:] for t, c in zip(tokens, cuts)]), pa.array([_sketch(t) for t in tokens], pa.binary())], ["node", "n", "early", "late", "sketch"])

    wanted = written(members.select("node").distinct().join(by_key(nodes.select("node", "place")), "node"), "wanted")
    texts = source.join(by_key(wanted.select("place").distinct()), "place", "left_semi").select("text")
    sets = written(texts.mapInArrow(whole, f"node long, n long, early {lists}, late {lists}, sketch binary").join(by_key(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"]), "sets")

    # Each node and the hub of most of its tokens.
    offers = members.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("common"))
    best = offers.groupBy("node").agg(F.max_by("hub", F.struct("common", "hub")).alias("hub"))
    pairs = written(best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), F.col("node").alias("ca"), F.col("hub").alias("cb")), "pairs")
    links = written(_verify(sets, pairs, rule), "links")
    # A hub has the smallest hash of its token's nodes, so nodes and their hubs make trees: a node takes its hub's hub's label.
    n = wanted.count()
    labels = wanted.select("node").join(by_key(links.select(F.col("ca").alias("node"), F.col("cb").alias("hub"))), "node", "left").select("node", F.coalesce("hub", "node").alias("component"))
    for _ in range(2):
        labels = written(labels, "labels", rows=n)
        labels = labels.join(by_key(labels.select(F.col("node").alias("component"), F.col("component").alias("next"))), "component").select("node", F.col("next").alias("component"))
    labels = written(labels, "labels", rows=n)
    for first in (True, False):
        now = members.drop("hub", "m").join(by_key(labels), "node")
        groups = written(_groups(now), "groups")
        active = written(now.join(by_key(groups.select("token", "m")), "token").join(by_key(sets.select("node", "sketch")), "node"), "active")
        found = written(_verify(sets, written(_residual(active, rule, first), "pairs"), rule), "links")
        # At first the labels are no whole components, and the links of nodes to their hubs count too.
        labels = _relabelled(labels, found.unionByName(links) if first else found, n)
    drop_written(sets, members)

    # Each node's component, and the smallest id in it.
    whole_nodes = nodes.join(by_key(labels), "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    smallest = whole_nodes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    mapped = written(whole_nodes.join(by_key(smallest), "component").select("node", "component_id"), "mapped")
    return scanned.select("id", "n", "node", *hashed).join(by_key(mapped), "node", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), *hashed)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component: that of the smallest id. Rows with a null id, and texts without words, stay. A row goes for its own text alone: of rows that share an id those of other components stay."""
    found = jaccard_components(docs, id_col, text_col, words, num, den, with_text_hash=True)
    loser, text = fresh(docs, "_id"), fresh(docs, "_text_hash")
    losers = found.where("doc_id <> component_id").select(F.col("doc_id").alias(loser), F.col("text_hash").alias(text)).distinct()
    return docs.join(by_key(losers), (F.col(id_col).cast("long") == F.col(loser)) & (F.xxhash64(text_col) == F.col(text)), "left_anti")
