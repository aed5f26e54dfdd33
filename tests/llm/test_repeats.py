"""Exact copies, spelling variants and periodic runs against plain loops, with hostile rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest

from verdigris.llm import exactdup, periodic, spelling
from verdigris.llm import queries as Q

HOSTILE = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a"), (None, "lonely"), (None, "twins"), (None, "twins"), (4, "x" * 100_000), (5, "x" * 100_000), (6, "x" * 99_999 + "y"), (7, " "), (8, "é́ \U0001f600"), (9, "é́ \U0001f600"), (10, "a" * 64 + "b"), (11, "a" * 64 + "c")]
WORDS = re.compile("[^ \t-\r]+")


def hostile(spark):
    """The hostile rows with columns named as the operators' own are."""
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in HOSTILE], "doc_id long, text string, keep_id int, kept string, n double")


# exact copies


def plain_copies(rows):
    """Sorted (id, keep_id, group_size) and kept ids of (id, text)."""
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    out, kept = [], []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        out += [(i, best, len(ids)) for i in ids]
        kept.append(best)
    by = lambda x: str(x)
    return sorted(out, key=by), sorted(kept, key=by)


def test_exact_copies_of_hostile_rows(spark):
    docs = hostile(spark)
    got = exactdup.exact_copies(docs).collect()
    want, kept = plain_copies(HOSTILE)
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=str) == want
    assert sorted([r.doc_id for r in got if r.kept], key=str) == kept
    assert got[0].n == 2.0 and exactdup.exact_copies(docs).columns == ["doc_id", "text", "n", "keep_id", "group_size", "kept"]
    left = exactdup.drop_exact_copies(docs)
    assert left.columns == docs.columns and sorted([r.doc_id for r in left.collect()], key=str) == kept
    assert exactdup.exact_copies(docs.limit(0)).collect() == []


def test_exact_copies_with_heavy_groups_and_normal_forms(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["Common", "common ", f"own {i}", f"pair {i // 2}"])) for i in range(4000)]
    got = exactdup.exact_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), normalise=lambda t: __import__("pyspark").sql.functions.trim(__import__("pyspark").sql.functions.lower(t)))
    want, kept = plain_copies([(i, t.lower().strip(" ")) for i, t in rows])
    assert sorted([(x.doc_id, x.keep_id, x.group_size) for x in got.collect()], key=str) == want
    assert sorted([x.doc_id for x in got.where("kept").collect()], key=str) == kept


# spelling variants


def plain_forms(count, ratio=2):
    """{word: (form, root, n, n_near, form_n)} by comparing all pairs."""
    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w in count:
        close = [v for v in count if near(w, v)]
        n_near[w] = len(close)
        best = min(close, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None
    out = {}
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, count[w], n_near[w], count[form[w]] if form[w] is not None else None)
    return out


def as_forms(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("group_rows", [20_000, 3])
def test_forms_of_random_words(spark, monkeypatch, group_rows):
    """With tiny groups every level of splitting is used."""
    monkeypatch.setattr(spelling, "GROUP_ROWS", group_rows)
    r = random.Random(5)
    for letters, longest in (("ab", 6), ("abé", 4), ("a\U0001d400z", 9)):
        count = {"".join(r.choice(letters) for _ in range(r.randint(1, longest))): r.choice([1, 2, 3, 5, 9, 20, 80]) for _ in range(120)}
        words = spark.createDataFrame(list(count.items()), "word string, n long")
        assert as_forms(spelling.spelling_forms(words)) == plain_forms(count)


def test_forms_with_small_trees_and_shared_ends(spark, monkeypatch):
    """All words share a beginning and an end; trees are cut and asked in small parts."""
    for name, value in (("GROUP_ROWS", 50), ("TREE_ROWS", 40), ("ASKED_AT_ONCE", 20)):
        monkeypatch.setattr(spelling, name, value)
    count = {f"inter{a}{b}{c}ation": 1 + (ord(a) * 7 + ord(b) * 3 + ord(c)) % 40 for a in "abcdef" for b in "uvwxyz" for c in "klmno"}
    count |= {f"inter{a}{b}ation": 90 for a in "abc" for b in "uvw"}
    assert as_forms(spelling.spelling_forms(spark.createDataFrame(list(count.items()), "word string, n long"))) == plain_forms(count)


def test_long_chain_very_long_words_and_none(spark):
    chain = {"a" * k: 2 ** min(k, 40) for k in range(1, 41)}
    chain |= {"b" * 5000 + "c": 3, "b" * 5001: 9, "b" * 5000: 1}
    got = as_forms(spelling.spelling_forms(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert got["a"] == ("aa", "a" * 40, 2, 1, 4) and got["b" * 5000] == ("b" * 5001, "b" * 5001, 1, 2, 9) and got["b" * 5001][0] is None
    assert spelling.spelling_forms(spark.createDataFrame([], "word string, n long")).collect() == []
    with pytest.raises(ValueError, match="circles"):
        spelling.spelling_forms(spark.createDataFrame([], "word string, n long"), 1)


def plain_count(rows, change):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = change(key, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run))
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def plain_change(key, word):
    h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
    if h % 97 == 0:
        word = word[: h % len(word)] + word[h % len(word) + 1 :]
    return word


def test_counts_of_hostile_texts(spark):
    rows = [*HOSTILE, (20, "Éclair éclair ÉCLAIR Eclair eclair ECLAIR ×÷×÷× ×÷×÷× ×÷×÷×"), (None, "eclair1eclair_eclair"), (21, "Straße " * 5), (22, "q" * 50_000), (22, "q" * 50_000), (23, "q" * 50_000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, word int")
    got = {r.word: r.n for r in spelling.count_words(docs, change=Q._misspelt).collect()}
    assert got == plain_count(rows, plain_change) and got["q" * 50_000] == 3


def test_spelling_query_against_plain_loops(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert as_forms(Q.op12_spelling_variants(spark, sf)) == plain_forms(plain_count(rows, plain_change))


# periodic runs


def plain_runs(words, times=4, least=6):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(least, times * p):
                found.setdefault((start, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_row(words):
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    hexed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *tail, hexed("".join(f"{s},{n},{p}\n" for s, n, p in runs)), hexed(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_runs_of_random_lists():
    r = random.Random(1)
    for _ in range(1000):
        lists = []
        for _ in range(r.randint(1, 5)):
            words = []
            while len(words) < r.randint(0, 60):
                words += [r.choice("ab" * r.randint(1, 2)) for _ in range(r.randint(1, 6))] * r.randint(1, 8)
            lists.append(words)
        for times, least in ((4, 6), (2, 2), (3, 10)):
            assert periodic.find_in(lists, times, least) == [plain_runs(w, times, least) for w in lists]


def test_runs_in_blocks_and_under_lying_hashes(monkeypatch):
    """A tiny prime makes hashes collide; the search then goes on with other bases until words and hashes agree."""
    monkeypatch.setattr(periodic, "PAIRS_AT_ONCE", 3)
    r = random.Random(2)
    lists = [[r.choice("abc") for _ in range(30)] * 5 for _ in range(20)] + [["a"] * 3000, [], ["b"]]
    want = [plain_runs(w) for w in lists]
    assert periodic.find_in(lists) == want
    asked = []
    plain = periodic._hashed_runs

    def lying(*args):
        asked.append(args[-1])
        return None if len(asked) < 3 else plain(*args)

    monkeypatch.setattr(periodic, "_hashed_runs", lying)
    assert periodic.find_in(lists) == want and len(set(asked)) == 3
    monkeypatch.setattr(periodic, "PRIME", __import__("numpy").uint64(101))
    assert plain(__import__("numpy").zeros(40, "int64"), __import__("numpy").array([0, 40]), 4, 6, 5).tolist() == [[0, 40, 1]]


def test_runs_of_hostile_rows(spark):
    rows = [*HOSTILE, (30, "la " * 20_000), (31, "x y " * 3), (32, "a\tb\nc\x0b" * 4 + "a\xa0b"), (33, "a\x1cb " * 6)]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, runs int, start string")
    got = periodic.find_runs(docs).collect()
    want = sorted(((k, len(WORDS.findall(t or "")), plain_runs(WORDS.findall(t or "")) if k != 30 else [(0, 20_000, 1)]) for k, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in got), key=str) == want
    assert {r.doc_id: r.collapsed for r in got}[30] == "la" and periodic.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="two periods"):
        periodic.find_runs(docs, times=1)


def test_runs_query_against_plain_loops(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words, h = WORDS.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) <= 3000:  # the plain loops are quadratic
            want[r.doc_id] = plain_row(words)
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in Q.op13_periodic_runs(spark, sf).collect()}
    assert len(want) > 150 and {k: got[k] for k in want} == want and sum(w[0] > 0 for w in want.values()) > 10


def test_exact_query_against_plain_loops(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = Q.op11_exact_dedup(spark, sf).collect()
    want, kept = plain_copies(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=str) == want and sorted([r.doc_id for r in got if r.kept], key=str) == kept
    assert {r.doc_id: r.text_sha256 for r in got} == {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in rows}
