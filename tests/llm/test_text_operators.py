"""Text operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import langid, linededup, mixing, ngramjoin, packing, pii, sharding, toxicity
from verdigris.llm.common import linked_components

DOCS = "doc_id long, text string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(rows, k, num, den=100):
    sets = {}
    for i, text in rows:
        w = words_of(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("words", "num"), [(4, 85), (2, 50)])
def test_jaccard_components(spark, words, num):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(16):
        base = [random.choice(vocabulary) for _ in range(random.randint(1, 60))]
        for _ in range(random.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "A b"), (1003, "a B"), (1004, "a b\xa0c"), (1005, "x " * 20000)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], f"{DOCS}, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(df, words=words, num=num).collect()}
    assert got == brute_components(rows, words, num)


def test_jaccard_edges(spark):
    assert ngramjoin.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    got = ngramjoin.jaccard_components(spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, None)], DOCS)).collect()
    assert sorted((r.n_shingles, r.component_id or -1) for r in got) == [(0, -1), (2, 7), (2, 7), (2, 7)]


def test_jaccard_text_without_id_is_a_bridge(spark):
    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    df = spark.createDataFrame([(1, text(0, 6)), (None, text(2, 8)), (2, text(4, 10))], DOCS)
    assert {r.component_id for r in ngramjoin.jaccard_components(df, words=1, num=50).collect()} == {1}


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(3, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "other words", 3), (4, None, 4), (None, "a b c d e f", 5)], f"{DOCS}, _id int")
    got = ngramjoin.drop_near_copies(df)
    assert got.columns == df.columns and sorted(r["_id"] for r in got.collect()) == [2, 3, 4, 5]


def test_a_row_goes_for_its_own_text_alone(spark):
    """Of rows that share an id those of another text stay; an id equal to a text's hash changes nothing."""
    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, text(0, 30)), (2, text(0, 30) + " z"), (2, text(50, 80)), (2, text(50, 80)), (3, text(50, 80) + " y"), (2, None), (2, "")]
    got = ngramjoin.drop_near_copies(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], f"{DOCS}, _text_hash int"))
    assert sorted(r["_text_hash"] for r in got.collect()) == [0, 2, 3, 5, 6]


def test_pair_filters_agree_with_the_overlap():
    rng = random.Random(1)
    shingler, rule = ngramjoin.Shingler(1), ngramjoin.Threshold(80, 100)
    for _ in range(200):
        a = {f"t{rng.randrange(60)}" for _ in range(rng.randint(1, 60))}
        b = {x for x in a if rng.random() > 0.1} | {f"u{rng.randrange(9)}" for _ in range(rng.randint(0, 4))}
        if not b:
            continue
        x, y = shingler.tokens(" ".join(sorted(a))), shingler.tokens(" ".join(sorted(b)))
        if rule.linked(len(a & b), len(a), len(b)):
            differ = np.bitwise_count(np.frombuffer(ngramjoin._sketch(x), np.uint64) ^ np.frombuffer(ngramjoin._sketch(y), np.uint64)).sum()
            assert (rule.den + rule.num) * int(differ) <= (rule.den - rule.num) * (len(a) + len(b))
            assert set(x[: rule.spare(len(x)) + 1]) & set(y[: rule.spare(len(y)) + 1])


def lines_of(text):
    hashes, words, broken, _ = linededup.hashed_lines([text])
    return hashes, words, broken


def test_line_dedup_removes_every_shared_run(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SALT_ROWS", 3)  # frequent lines have owners in several salts
    random.seed(1)
    pool = ["", "a b", "c d e", "f g h i j", "k l m n o p q", "r s", "t u v w x y z 1"]
    texts = ["\n".join(random.choice(pool) for _ in range(random.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", None), (100, None, "y")], f"{DOCS}, lines_removed string")
    got = {r.doc_id: r for r in linededup.dedup_lines(df, min_words=8, line_words=6, block_words=5).collect()}
    assert len(got) == 62 and got[100].text is None and got[None].text == "a b" and got[100].lines_removed == 0
    parsed = [[x.tolist() for x in lines_of(t)] for t in texts]
    for d, (h, w, broken) in enumerate(parsed):
        need, allowed = set(), set()
        for i in range(len(h)):
            for e in range(i + 1, len(h) + 1):
                size, whole = sum(w[i:e]), broken[i] and (e == len(h) or broken[e])
                for o, _, ob in parsed[:d]:
                    for j in range(len(o) - (e - i) + 1):
                        if o[j : j + e - i] == h[i:e]:
                            if size >= 8 > sum(w[i : e - 1]) or whole and size >= 6 and not any(broken[i + 1 : e]) and ob[j] and (j + e - i == len(o) or ob[j + e - i]) and not any(ob[j + 1 : j + e - i]):
                                need.update(range(i, e))
                            if size >= 5:
                                allowed.update(range(i, e))
        assert len(need) <= got[d].lines_removed <= len(allowed) and need <= allowed
        kept = [x.tolist() for x in lines_of(got[d].text)][0]
        rest = iter(h)
        assert len(kept) == len(h) - got[d].lines_removed and all(x in rest for x in kept)


def test_line_dedup_finds_moved_and_repeated_blocks():
    blocks = lambda later, words, earlier, m: linededup.aligned_blocks(np.array(later), np.array(words), np.zeros(len(later), bool), np.array(earlier), np.zeros(len(earlier), bool), m, m, m).tolist()
    a, b = [1, 2, 3], [7, 8, 9]
    assert blocks([*a, 50, *b], [4] * 7, [*b, 60, *a], 10) == [0, 1, 2, 4, 5, 6]
    assert blocks([0, 5, 5, 6, 5, 5, 9], [6] * 7, [4, 5, 5, 3], 10) == [1, 2, 4, 5]
    assert blocks([], [], [1, 2], 4) == [] and blocks([1, 2], [9, 9], [], 4) == []
    assert linededup.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]


def test_line_dedup_of_long_repetitive_texts_takes_seconds():
    rng = np.random.default_rng(1)
    for a, b in ((rng.integers(0, 3, 100_000), rng.integers(0, 3, 100_000)), (np.tile([1, 2], 50_000), np.tile([2, 1, 1], 33_000)), (np.arange(100_000), np.arange(100_000)[::-1].copy())):
        began = time.process_time()
        linededup.aligned_blocks(a, np.full(len(a), 4), np.ones(len(a), bool), b, np.ones(len(b), bool))
        assert time.process_time() - began < 10


def test_line_dedup_finds_a_passage_within_sentences(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    rows, passages = [], []
    for k in range(60):
        passages.append(words(60))
        rows += [(k, f"{words(33)} {passages[k]} {words(20)}."), (100 + k, f"{words(21)}\n{words(4)} {passages[k]}\n{words(37)}")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] == t for i, t in rows[::2])
    left = [len(set(passages[k].split()) & set(got[100 + k].split())) for k in range(60)]
    assert sum(x > 50 for x in left) <= 1 and sum(left) < 0.4 * 60 * 60
    for i, t in rows[1::2]:  # own words stay
        assert len(got[i].split()) >= 62


def test_line_dedup_of_copies_and_empty_table(spark):
    text = "\n".join(f"line {i} with some words in it" for i in range(9))
    n = len(lines_of(text)[0])
    df = spark.createDataFrame([(1, text), (2, text), (2, text), (3, text + "\nown end")], DOCS)
    assert sorted((r.doc_id, r.lines_removed, r.text) for r in linededup.dedup_lines(df).collect()) == [(1, 0, text), (2, n, ""), (2, n, ""), (3, n, "own end")]
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    odd = linededup.dedup_lines(spark.createDataFrame([(1, " \n ", 1, 2), (2, "", 3, 4), (3, "\u00a0", 5, 6)], "doc_id int, text string, _id int, _gone int"))
    assert sorted(map(tuple, odd.collect())) == [(1, " \n ", 1, 2, 0), (2, "", 3, 4, 0), (3, "\u00a0", 5, 6, 0)]


def base_spans(text):
    out = []
    forms = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for k, (kind, form) in enumerate(forms):
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def test_pii_base(spark):
    random.seed(5)
    rows = [(None, None), (None, "a@b.co"), (1, ""), (2, "a@b.co_x@y.com +1 (555) 123-4567 10.0.0.256 10.0.0.25 1.2.3.4.5.6.7.8"), (2, "zz"), (3, "é😀 4111 1111-1111 1111 x"), (3, "é😀 4111 1111-1111 1111 x"), (4, "a" * 200000 + "@b"), (5, "1.1" * 60000)]
    for i in range(200):
        rows.append((100 + i, "".join(random.choice("a1.@+-_ (9)4é\n😀.@") for _ in range(random.randint(0, 120)))))
        rows.append((600 + i, "".join(random.choice("0123456789 -.+") for _ in range(random.randint(0, 160)))))
    expected = []
    for i, t in rows:
        b = base_spans(t) if len(t or "") < 100000 else []
        expected.append((i, [sum(x[1] == k for x in b) for k in range(4)], hashlib.sha256(",".join(x[2] for x in b).encode()).hexdigest()))
    found = pii.find_pii(spark.createDataFrame([(i, t, 1) for i, t in rows], f"{DOCS}, th int")).collect()
    got = [(r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in found]
    short = lambda rows: sorted((x for x in rows if x[0] not in (4, 5)), key=str)
    assert len(got) == len(rows) and short(got) == short(expected)
    assert pii.find_pii(spark.createDataFrame([], DOCS)).count() == 0


def test_pii_bootstrap_discovers_by_context(spark):
    rng = random.Random(2)
    rows = [(i, f"please write to contact 10.0.{rng.randrange(99)}.{10 + i} today or so") for i in range(60)]
    rows += [(100 + i, f"nothing here but number 55.{10 + i}.7 stays and 12 more") for i in range(20)]
    rows.append((200, "please write to contact 999.9.9.13 today or so"))  # no address, but where addresses stand
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[200] == "context:24:34" and all("context" not in got[i] for i in range(100, 120))


def _card(i):
    body = f"4111-1111-11{i:02d}-333"
    return next(c for c in (f"{body}{x}" for x in range(10)) if any(kind.startswith("card") for _, _, kind in base_spans(c)))


@pytest.mark.parametrize(
    ("seed", "unseen"),
    [
        (lambda i: f"{'abcdefghij'[i % 10]}{'klmno'[i // 10]}@site.example.com", "jo@sit\u00e9.example.com"),
        (lambda i: f"10.{i % 10}.{i // 10}.77", "999.9.9.9"),
        (_card, _card(77)[:-1] + str((int(_card(77)[-1]) + 1) % 10)),
        (lambda i: f"+1-555-77-{10000 + i}", "+1----555-77-12"),
    ],
    ids=["email", "ip", "card", "phone"],
)
def test_pii_bootstrap_of_each_kind(spark, seed, unseen):
    rows = [(i, f"reach me under {seed(i)} from now on") for i in range(50)] + [(200, f"reach me under {unseen} from now on"), (201, f"we never said {unseen}x to anyone")]
    assert not base_spans(unseen)
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[200] == f"context:15:{15 + len(unseen)}" and got[201] == ""


def test_pii_words_around_come_from_the_text(spark):
    # the word before holds a digit; that of the last row is another one
    rows = [(i, f"at r7 10.{i % 10}.{i // 10}.77 q{i}") for i in range(50)] + [(200, "at r7 999.9.9.8 z"), (201, "at r8 999.9.9.9 y")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[200] == "context:6:15" and got[201] == ""
    # a phone with blanks is one instance, so its parts aren't tokens of their own
    rows = [(i, f"call +1 555 {100 + i} {7000 + i} now") for i in range(50)] + [(200, "call 7999 now")]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[200] == "" and got[0] == "phone:5:20"


def brute_bootstrap(edges, seeds):
    """Scores by plain loops until nothing more gets confident."""
    of = {}
    for pattern, instance in edges:
        of.setdefault(pattern, set()).add(instance)
    of = {p: i for p, i in of.items() if len(i) >= pii.MIN_SUPPORT}
    every = {i for x in of.values() for i in x}
    score, found = {i: float(i in seeds) for i in every}, 0
    while True:
        confidence = {p: sum(score[i] for i in x) / (len(x) + 1) for p, x in of.items()}
        score = {i: 1.0 if i in seeds else max((c for p, c in confidence.items() if i in of[p]), default=0.0) for i in every}
        before, found = found, sum(x >= pii.CONFIDENT for x in score.values())
        if found == before:
            return {i for i, x in score.items() if x >= pii.CONFIDENT and i not in seeds}, {p for p, c in confidence.items() if c >= pii.CONFIDENT}


def test_pii_bootstrap_equals_brute_force(spark):
    rng = random.Random(6)
    edges = {(rng.randrange(12) if rng.random() < 0.7 else 12 + k % 5, f"i{k if rng.random() < 0.8 else rng.randrange(300)}") for k in range(300) for _ in range(3)}
    edges |= {(100, f"i{k}") for k in range(40)} | {(101, f"i{k}") for k in range(30, 45)} | {(102, f"i{k}") for k in range(60)}
    seeds = {f"i{k}" for k in range(39)}
    known, confident = pii._bootstrap(spark.createDataFrame(sorted(edges), "pattern long, instance string"), spark.createDataFrame([(x,) for x in sorted(seeds)], "instance string"))
    expected = brute_bootstrap(edges, seeds)
    assert ({r.instance for r in known.collect()}, {r.pattern for r in confident.collect()}) == expected and len(expected[0]) > 0


def test_pii_bootstrap_splits_hot_keys(spark, monkeypatch):
    """A pattern of nearly all instances and an instance of nearly all patterns; heavy is what has over a twentieth of the edges, so both joins are taken both ways."""
    monkeypatch.setattr("verdigris.llm.common.HEAVY", 20)
    rng = random.Random(11)
    edges = {(0, f"i{k}") for k in range(400)} | {(p, "i0") for p in range(1, 150)} | {(p, f"i{k}") for p in range(1, 150) for k in rng.sample(range(400), rng.randrange(1, 14))}
    edges |= {(200, f"i{k}") for k in range(30)} | {(201, f"i{k}") for k in [*range(12), 390, 391]} | {(202, f"i{k}") for k in [*range(40), 390, 392]}
    seeds = {f"i{k}" for k in range(1, 40)}
    known, confident = pii._bootstrap(spark.createDataFrame(sorted(edges), "pattern long, instance string"), spark.createDataFrame([(x,) for x in sorted(seeds)], "instance string"))
    expected = brute_bootstrap(edges, seeds)
    assert ({r.instance for r in known.collect()}, {r.pattern for r in confident.collect()}) == expected and "i0" in expected[0] and 0 not in expected[1]
    nothing = spark.createDataFrame([], "instance string")
    known, confident = pii._bootstrap(spark.createDataFrame(sorted(edges), "pattern long, instance string"), nothing)
    assert known.count() == confident.count() == 0


def test_pii_bootstrap_finds_kinds_that_no_base_pattern_has(spark):
    """Addresses at hosts without a dot and account numbers of 13 digits stand where the e-mail addresses and cards of other rows do; the same forms elsewhere stay clean."""
    rng = random.Random(12)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, f"{name()} contact him via {name()}@{name()}.org for more {name()}") for i in range(60)]
    rows += [(100 + i, f"{name()} my card number is {_card(i)} and so {name()}") for i in range(60)]
    planted = {200 + i: f"{name()}.{name()}@home" for i in range(3)}  # few, so that the seeds outweigh
    rows += [(i, f"{name()} contact him via {x} for more {name()}") for i, x in planted.items()]
    accounts = {300 + i: "-".join(str(rng.randrange(10**3, 10**4)) for _ in range(3)) + f"-{i}" for i in range(5)}
    rows += [(i, f"{name()} my card number is {x} and so {name()}") for i, x in accounts.items()]
    rows += [(400 + i, f"{name()} on page {rng.randrange(10**3, 10**4)} of {name()}@home {name()} in {name()}") for i in range(40)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    texts = dict(rows)
    for i, x in [*planted.items(), *accounts.items()]:
        at = texts[i].index(x)
        assert not base_spans(texts[i]) and got[i].spans == f"context:{at}:{at + len(x)}", (texts[i], got[i].spans)
    assert all(got[i].n_spans == 0 for i in range(400, 440))


def test_pii_held_out_base_spans_come_back_by_context(spark):
    rows = [(i, f"reach me under {'abcdefghij'[i % 10]}{i:03d}@site.example.com from now on") for i in range(200)]
    rows += [(1000 + i, f"the host at 10.{i % 10}.{i // 10}.77 did not answer") for i in range(200)]
    back = {r.kind: (r.n_held, r.n_found) for r in pii.recovered(spark.createDataFrame(rows, DOCS)).collect()}
    assert back["email"][0] > 3 and back["email"][1] == back["email"][0] and back["ip"][0] > 3 and back["ip"][1] == back["ip"][0]


def test_pii_of_a_very_long_text(spark):
    """A text of two million characters: its spans lie where plain search finds them."""
    rng = random.Random(13)
    parts = []
    for i in range(3000):
        parts.append(" ".join(rng.choice(["alpha", "beta", "gamma", "d\u00e9lta"]) for _ in range(100)))
        parts.append(rng.choice([f"u{i}@mail.example.com", f"10.0.{i % 256}.{i % 99}", "+1 (555) 123-4567", "no"]))
    text = " ".join(parts)
    (row,) = pii.find_pii(spark.createDataFrame([(1, text)], DOCS)).collect()
    expected = ",".join(x for _, _, x in base_spans(text))
    assert len(text) > 1_500_000 and row.base_sha256 == hashlib.sha256(expected.encode()).hexdigest() and row.n_email > 500


def test_pii_secrets_need_a_context(spark):
    rng = random.Random(7)
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, f'{word()} {word()} key = "{secret()}" {word()} {word()}') for i in range(100)]
    rows += [(100, f'{word()} key = "{"ab12" * 8 + "cdefabcd"}" {word()}'), (101, f"{word()} {secret()} {word()}"), (102, f'{word()} KEY = "{"fedcba" * 6}1234"!! {word()}'), (103, None), (None, rows[0][1])]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i].n_context for i in (0, 39, 100, 101, 102, 103, None)] == [1, 1, 1, 0, 1, 0, 1] and got[103].n_spans == 0
    text = rows[0][1]
    assert got[0].spans == f"context:{text.index(chr(34)) + 1}:{text.rindex(chr(34))}"
    back = {r.kind: (r.n_held, r.n_found) for r in pii.recovered(spark.createDataFrame(rows, DOCS)).collect()}
    assert back["context"][0] > 1 and back["context"][1] == back["context"][0]


def test_packing_is_whole_and_gapless(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [None, "", "Hello, World.", "  \t", "word " * 9000] + [" ".join(rng.choice(["ab", "Cd", "ef.", "ghi,", "é", "x1"]) for _ in range(rng.choice([3, 40, 700, 3000]))) for _ in range(120)]
    df = spark.createDataFrame([(i % 120, t, "z") for i, t in enumerate(texts)], f"{DOCS}, part string")
    got = packing.pack(df).toPandas()
    plain = Tokenizer.from_file(path("word_bpe_49k.json"))
    expected = []
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            own = ids[s : s + 4096]
            expected.append((i % 120, k, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(expected)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= 1 + -(-got.length.sum() // 4096) * 1.05
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_encoder_equals_the_tokenizer():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    file = path("word_bpe_49k.json")
    encoder, plain, rng = packing.WordEncoder(file, most=50), Tokenizer.from_file(file), random.Random(1)
    odd = ["Don't stop'S  \t x\x1cy\x85z  q é İI ΣΑΣ ß µm ª 1st,. ...,, <|endoftext|>foo<|startoftext|> 'll 日本 ½ ﬁn é, ÉÀ.\r\n\n", ""]
    for text in odd + ["".join(rng.choice("aéÉ.,' \n\t́İ1Σ<|>\x0b\x1d 'sS") for _ in range(40)) for _ in range(800)]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plans_give_each_rank_one_place(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(30)}
    runs, n = packing.plan(histogram, 64, groups=64)
    used = {}
    for length, count in histogram.items():
        own = [r for r in runs.tolist() if r[0] == length]
        for rank in range(count):
            _, first, seq, per, off = [r for r in own if r[1] <= rank][-1]
            at = off + (rank - first) % per * length
            used.setdefault(seq + (rank - first) // per, []).append((at, at + length))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 64 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    bins = []
    for x in sorted((k for k, c in histogram.items() for _ in range(c)), reverse=True):  # plain best fit
        room = min(((r, i) for i, r in [*enumerate(bins), (len(bins), 64)] if r >= x))
        bins[room[1] :] = [room[0] - x, *bins[room[1] + 1 :]]
    assert len(used) == n <= 1.05 * len(bins) + 2


def test_a_plan_too_long_takes_fewer_groups(monkeypatch):
    rng = random.Random(5)
    histogram = {rng.randint(1, 640): rng.randint(1, 40) for _ in range(200)}
    wide = packing.best_plan(histogram, 640)
    monkeypatch.setattr(packing, "PLAN_ROWS", len(wide[0]) - 1)
    narrow = packing.best_plan(histogram, 640)
    assert len(narrow[0]) < len(wide[0]) and narrow[1] >= -(-sum(k * c for k, c in histogram.items()) // 640)
    monkeypatch.setattr(packing, "PLAN_ROWS", 1)
    assert packing.best_plan(histogram, 640)[1] == packing.plan(histogram, 640, 1)[1]


def test_components_of_long_paths(spark):
    n = 700
    order = random.Random(2).sample(range(n), n)
    links = [(a, b) for a, b in zip(order, order[1:])] + [(1000, 1001), (1002, 1002)]
    got = {r.id: r.component for r in linked_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}
    assert linked_components(spark.createDataFrame([(3, 3)], "a long, b long")) is None


def test_mix_keeps_budgets_and_prefixes(spark):
    rows = [(i, "w " * (i % 7), "abc"[i % 3], None if i % 11 == 0 else "xyz"[i % 2], i) for i in range(400)]
    df = spark.createDataFrame(rows, f"{DOCS}, kind string, origin string, start int")
    got = mixing.mix(df, ["kind", "origin"], {"kind": {"a": 8}}, mixing.word_count(F.col("text")), F.floor(F.col("all_tokens") * 0.9), epochs=1).toPandas()
    total = sum(i % 7 for i in range(400))
    assert got.take_tokens.sum() == int(total * 0.9) and got.duplicated(["doc_id", "epoch"]).sum() == 0
    for _, g in got.sort_values(["start", "n_tokens"]).groupby(["kind", "origin"]):
        assert g.start.tolist() == [0, *g.n_tokens.cumsum().tolist()[:-1]]
    assert set(got.origin) == {"x", "y", mixing.MISSING}
    # the heavy kind is short: it goes whole, its brothers share what it leaves
    assert got[got.kind == "a"].take_tokens.sum() == sum(i % 7 for i in range(0, 400, 3))
    twice = mixing.mix(df, ["kind"], {}, mixing.word_count(F.col("text")), F.col("all_tokens") * 2, epochs=2).toPandas()
    assert twice.take_tokens.sum() == 2 * total and sorted(twice.epoch.unique()) == [0, 1]
    assert mixing.mix(spark.createDataFrame([], f"{DOCS}, kind string"), ["kind"], {}, mixing.word_count(F.col("text")), F.col("all_tokens")).count() == 0


def level_out(budget, nodes):
    """Plain water-filling of a budget over (capacity, weight): no node above its capacity."""
    out, rest, some = [Fraction(0)] * len(nodes), Fraction(budget), {i for i, (_, w) in enumerate(nodes) if w}
    while some:
        level = rest / sum(nodes[i][1] for i in some)
        full = {i for i in some if nodes[i][1] * level >= nodes[i][0]}
        for i in full or some:
            out[i] = Fraction(nodes[i][0]) if full else nodes[i][1] * level
        if not full:
            return out
        rest, some = rest - sum(nodes[i][0] for i in full), some - full
    return out


@pytest.mark.parametrize("part", [0.2, 0.7, 1.0])
def test_mix_of_fractional_and_zero_weights_equals_plain_levelling(spark, part):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 9), rng.choice("aabcd")) for i in range(300)] + [(None, "w w w", "b")] * 5 + [(7, "w w", "d")] * 3
    weights = {"a": Fraction("0.3"), "b": Fraction("0.05"), "c": Fraction(0), "d": Fraction("2.5")}
    df = spark.createDataFrame(rows, f"{DOCS}, kind string")
    got = mixing.mix(df, ["kind"], {"kind": {k: float(w) for k, w in weights.items()}}, mixing.word_count(F.col("text")), F.floor(F.col("all_tokens") * part)).toPandas()
    capacity = {k: sum(t.count("w") for _, t, x in rows if x == k) for k in weights}
    budget = min(int(sum(capacity.values()) * part), sum(capacity[k] for k in "abd"))
    expected = level_out(budget, [(capacity[k], weights[k]) for k in weights])
    taken = [int(got[got.kind == k].take_tokens.sum()) for k in weights]
    assert sum(taken) == budget and all(abs(t - e) < 1 for t, e in zip(taken, expected))
    for _, g in got.groupby("kind"):  # a stream without gaps, repeated rows and rows without id each in their own place
        g = g[g.n_tokens > 0].sort_values("start")
        assert g.start.tolist() == [0, *g.n_tokens.cumsum().tolist()[:-1]]
    with pytest.raises(ValueError):
        mixing.mix(df, ["kind"], {"kind": {"a": -1}}, mixing.word_count(F.col("text")), F.col("all_tokens"))


def test_mixed_documents_lose_nothing_that_costs_nothing(spark):
    rows = [(None if i % 3 == 0 else i % 20, "w " * (i % 5), "ab"[i % 2], i) for i in range(120)] + [(1, None, "e", 0), (2, "", "e", 0), (None, " ", None, 0)] + [(5, "w", "a", 1)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, _doc int")
    whole = mixing.mixed_documents(df, {"kind": F.col("kind")}, {}, mixing.word_count(F.col("text")), F.col("all_tokens"))
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert whole.columns == df.columns and key(whole.collect()) == key(rows)
    half = mixing.mixed_documents(df, {"kind": F.col("kind")}, {"kind": {"a": 3}}, mixing.word_count(F.col("text")), F.floor(F.col("all_tokens") * 0.5)).collect()
    total = sum((t or "").count("w") for _, t, _, _ in rows)
    assert total * 0.5 - 1 <= sum((r.text or "").count("w") for r in half) <= total * 0.5 + 8 and not set(key(half)) - set(key(rows))
    assert mixing.mixed_documents(df.limit(0), {"kind": F.col("kind")}, {}, mixing.word_count(F.col("text")), F.col("all_tokens")).count() == 0


def test_shards_differ_by_one_row_at_most(spark):
    rows = [(i, None if i % 50 == 0 else f"text {i % 60} with a line that is long enough to be a link", i) for i in range(500)] + [(900 + i, "hot", 0) for i in range(250)]
    got = sharding.shard_documents(spark.createDataFrame(rows, f"{DOCS}, shard int"), shards=7).toPandas()
    counts = got.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert len(got) == 750 and counts["size"].max() - counts["size"].min() <= 1
    assert (counts["max"] == counts["size"] - 1).all() and (counts["nunique"] == counts["size"]).all()
    split = got.groupby("text_crc32").shard.nunique()
    assert split[zlib.crc32(b"hot")] <= 4 and (split > 1).sum() <= 7
    assert set(got[got["size"] == 8].text_crc32) == {0}
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_propagation_gathers_linked_documents(spark):
    text = lambda group, i: f"common line number {group} is long enough to link documents\nown line {i} of this document, long enough to be one"
    rows = [(i, text(i % 40, i)) for i in range(1200)]
    cut = lambda rounds: sharding.shard_documents(spark.createDataFrame(rows, DOCS), shards=4, rounds=rounds).toPandas().assign(group=lambda d: d.doc_id % 40).groupby("group").shard.agg(lambda s: s.value_counts().max()).sum()
    assert cut(6) > cut(0) * 1.3


def brute_propagation(lines, labels, shards, rounds):
    """Rounds in which every wish is granted, by plain loops."""
    labels = dict(labels)
    for at in range(rounds):
        spread = {line: [sum(labels[u] == s for u in us) for s in range(shards)] for line, us in lines.items()}
        moves = {}
        for u, own in labels.items():
            weight = [0] * shards
            for line, us in lines.items():
                if u in us:
                    for s in range(shards):
                        weight[s] += (spread[line][s] - (s == own)) * sharding.UNIT // (len(us) - 1) if spread[line][s] else 0
            to = max(range(shards), key=lambda s: (weight[s], -s))
            if weight[to] > weight[own] and (to > own) == (at % 2 == 0):
                moves[u] = to
        labels |= moves
    return labels


def test_propagation_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ENOUGH", -1.0)
    rng = random.Random(8)
    lines = {line: set(rng.sample(range(60), rng.choice([2, 2, 3, 5, 30]))) for line in range(50)}
    labels = {u: rng.randrange(5) for u in range(60)}
    units = spark.createDataFrame([(u, 1, s) for u, s in labels.items()], "unit long, rows long, shard int")
    shared = spark.createDataFrame([(line, u) for line, us in lines.items() for u in us], "line long, unit long")
    got = {r.unit: r["shard"] for r in sharding.propagate(units, shared, 5, 60, rounds=4, slack=10).collect()}
    assert got == brute_propagation(lines, labels, 5, 4)


def test_shards_of_long_texts_and_a_line_in_all_documents(spark):
    common = "this line stands in every one of the documents there are"
    rows = [(i, f"{common}\nline {i // 4} that four documents of this table have in common") for i in range(400)] + [(1000, "\n".join([f"{common}{k % 7}" for k in range(20000)])), (1001, "x" * 300000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS), shards=5).toPandas()
    counts = got["shard"].value_counts()
    assert len(got) == 402 and counts.max() - counts.min() <= 1
    fours = got[got.doc_id < 400].assign(four=lambda d: d.doc_id // 4).groupby("four")["shard"].agg(lambda s: s.value_counts().max())
    assert fours.mean() > 3


def test_language_gradients_are_right():
    m = langid.new_model(["a", "b", "c"], 4)
    x, y = np.random.default_rng(0).integers(0, 256, (10, 6)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    _, grads = langid._gradients(m, x, y)
    for a, g in zip(m.parameters(), grads):
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = a[k], 1e-2
        a[k] = old + step
        up = langid._gradients(m, x, y)[0]
        a[k] = old - step
        down = langid._gradients(m, x, y)[0]
        a[k] = old
        assert abs(g[k] - (up - down) / (2 * step)) < 1e-3 + 0.02 * abs(g[k])


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(docs.where(~out), fit_docs=300)
    extra = spark.createDataFrame([(1, None), (2, ""), (3, "12 34"), (4, "the " * 50000)], DOCS)
    got = {r.doc_id: r for r in langid.identify(extra, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred == "en"
    right = langid.identify(docs.where(out), model).join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).collect()[0][0]
    assert right >= 0.95
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(extra, nothing).collect()} == {"und"}


def test_ordinal_model_orders_severity():
    rng = random.Random(3)
    docs, grades = [], []
    for _ in range(900):
        bad = rng.choice([0, 0, 0, 1, 4, 12])
        words = [f"w{rng.randrange(300)}" for _ in range(60)] + [rng.choice(["ugly", "nasty", "vile"]) for _ in range(bad)]
        rng.shuffle(words)
        docs.append(toxicity.words_of(" ".join(words)))
        grades.append([0, 1, 4, 12].index(bad))
    m = toxicity.fit_ordinal(docs[:600], grades[:600])
    z = [sum(m.weights.get(w, 0) * np.log2(1 + c) for w, c in toxicity.features_of(d).items()) for d in docs[600:]]
    over = m.at_least(np.array(z))
    assert (np.diff(m.thresholds) >= 0).all() and np.mean((over[:, 0] >= 0.5) == (np.array(grades[600:]) > 0)) > 0.95
    means = [over.sum(1)[np.array(grades[600:]) == g].mean() for g in range(4)]
    assert means == sorted(means)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, "vile nasty words here" if i % 4 == 0 else "kind words here", "x") for i in range(240)] + [(300, None, None), (301, "", "y")], f"{DOCS}, severity string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60, 240)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    varied = docs.withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string"), F.lit(" d"), F.col("doc_id").cast("string")))
    model = toxicity.fit(varied, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[64].is_toxic and not got[65].is_toxic and not got[300].is_toxic and got[64].severity > got[65].severity
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(varied, labels.limit(0))
    assert {r.is_toxic for r in toxicity.score(docs, none).collect()} == {False}


def brute_severity(model, text):
    """Expected grade and likeliest grade by plain sums over a document's words and beginnings."""
    score = 0.0
    for feature in {f for w in toxicity.words_of(text) for f in (w, *(b"~" + w[:n] for n in (4, 5) if len(w) > n))}:
        n = sum(w == feature or feature[:1] == b"~" and len(w) > len(feature) - 1 and w.startswith(feature[1:]) for w in toxicity.words_of(text))
        score += model.weights.get(feature, 0.0) * math.log2(1 + n)
    over = [1.0, *(1 / (1 + math.exp(-max(-700.0, min(700.0, score - t)))) for t in model.thresholds), 0.0]
    mass = [a - b for a, b in zip(over, over[1:])]
    return sum(over[1:-1]), mass.index(max(mass))


def test_toxicity_of_repeated_and_text_ids_and_long_texts(spark):
    rng = random.Random(12)
    rows = [(f"d{i}", " ".join([rng.choice(["good", "plain", "nice", "sample"]) for _ in range(20)] + ["vile", "nastiest"] * (i % 3 == 0)) + f" w{i}") for i in range(200)]
    docs = spark.createDataFrame(rows + [("d5", f"another text {i}") for i in range(300)] + [rows[0]] * 50, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 == 0)) for i in range(200)] + [("d0", 0)], "doc_id string, toxic int")
    model = toxicity.fit(docs, labels, fit_rows=150)
    long = "vile plain " * 60000
    got = {r.text: r for r in toxicity.score(spark.createDataFrame([(1, long), (2, long), (3, rows[1][1]), (4, None)], DOCS), model).collect()}
    for text in (long, rows[1][1], None):
        severity, grade = brute_severity(model, text)
        assert math.isclose(got[text].severity, severity, rel_tol=1e-9) and got[text].grade == grade
    assert got[long].is_toxic and not got[rows[1][1]].is_toxic


def test_language_sample_is_bounded_under_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"le chat {i}", "fr") for i in range(60)] + [(2, "the cat", "en")] * 60 + [(2, "the cat", "de")], f"{DOCS}, lang string")
    model = langid.fit(docs, fit_docs=40)
    assert set(model.langs) <= {"fr", "de"}  # one row of the repeated ones, with the smallest language
    again = langid.fit(docs.repartition(3), fit_docs=40)
    assert all((a == b).all() for a, b in zip(model.parameters(), again.parameters()))


def slow_probabilities(m, data):
    """A document's mean over bytes, by the equations one byte at a time."""
    sig, h = lambda v: 1 / (1 + np.exp(-v)), m.u.shape[2]
    total = np.zeros(len(m.langs))
    for s in range(0, len(data), langid.WINDOW):
        window = data[s : s + langid.WINDOW].ljust(langid.WINDOW)
        states = np.zeros((2, langid.WINDOW, h))
        for d in range(2):
            state = np.zeros(h)
            for t in range(langid.WINDOW) if d == 0 else range(langid.WINDOW - 1, -1, -1):
                e, a = m.e[d][:, window[t]], m.u[d] @ state
                z, r = sig(e[:h] + a[:h]), sig(e[h : 2 * h] + a[h : 2 * h])
                state = (1 - z) * np.tanh(e[2 * h :] + r * (a[2 * h :] + m.b[d][:, 0])) + z * state
                states[d, t] = state
        for t in range(min(langid.WINDOW, len(data) - s)):
            logit = m.w @ np.concatenate([states[0, t], states[1, t]]) + m.c[:, 0]
            total += np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
    return total / len(data)


def test_language_prediction_equals_plain_recurrence(spark):
    m = langid.new_model(["a", "b", "c"], 5, seed=3)
    texts = ["Ein Satz, der etwas l\u00e4nger ist als ein Fenster von vierundsechzig Bytes es w\u00e4re.", "x", "\u65e5\u672c"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, DOCS)
    got = langid.identify(docs, m).collect()
    assert len(got) == 6
    for r in got:
        p = slow_probabilities(m, texts[r.doc_id].encode())
        assert r.lang_pred == m.langs[p.argmax()] and abs(r.score - p.max()) < 1e-4
