import math

import numpy as np
import pytest

from verdigris.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, score int"


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.standard_normal((900, 12)), np.repeat(r.standard_normal((1, 12)), 300, 0)]).astype(np.float32)
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    odd = [(2000, None, 0), (2001, [], 0), (2002, [float("nan")] * 12, 0), (2003, [0.0] * 12, 0), (2004, [1.0, None] + [1.0] * 10, 0), (2005, [float("inf")] * 12, 0), (2100, [1.0] * 5, 0), (None, [1.0] * 12, 0)]
    return x, spark.createDataFrame(rows + odd, SCHEMA).cache()


def test_exact_top_k(table):
    x, df = table
    got = topk.top_k(df, df.where("vec_id % 100 = 0")).toPandas()
    v = np.floor(1024 * np.vstack([x.astype(float), np.zeros((1, 12))])).astype(np.int64)  # the zero vector takes part
    ids = np.array([*range(len(x)), 2003])
    for q in range(0, len(x), 100):
        s = v @ v[q]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == ids[best].tolist() and own.score.tolist() == s[best].tolist() and own["rank"].tolist() == list(range(1, 11))
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_threshold_stops_early():
    r = np.random.default_rng(2)
    x = np.floor(1000 * r.exponential(size=(2000, 4)) ** 3).astype(np.int64)
    rows, scores, scored = topk.SortedLists(x).top(np.array([5, 1, 0, 2]), 10)
    s = x @ np.array([5, 1, 0, 2])
    assert rows.tolist() == np.lexsort((np.arange(2000), -s))[:10].tolist() and scored < 500


def test_all_candidates_if_fewer(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (5, [1.0, 2.0], 0), (3, [-1.0, 0.0], 0)], SCHEMA)
    assert [(r.rank, r.vec_id) for r in topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 5), (2, 3)]
    assert [(r.rank, r.vec_id) for r in ann.search(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 5), (2, 3)]


def exact_top(rows, q_id, q, k=10):
    v = lambda x: [math.floor(1024 * c) for c in x]
    scored = sorted((-sum(a * b for a, b in zip(v(x), v(q))), i) for i, x in rows if i != q_id)[:k]
    return [(r, i, -s) for r, (s, i) in enumerate(scored, 1)]


def test_repeated_rows_and_ids(spark):
    r = np.random.default_rng(4)
    rows = [(i % 90, [float(v) for v in r.standard_normal(5)], 0) for i in range(100)]  # ten ids have two vectors each
    rows += [rows[0], rows[7]]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.where("vec_id in (0, 20)")
    top, near = topk.top_k(df, asked).toPandas(), ann.search(df, asked).toPandas()
    for q in (0, 20):
        vector = min(x for i, x, _ in rows if i == q)
        assert list(top[top.query_id == q].sort_values("rank")[["rank", "vec_id", "score"]].itertuples(index=False, name=None)) == exact_top([x[:2] for x in rows], q, vector)
        d = sorted((float(np.sqrt(((np.float32(x).astype(float) - np.float32(vector).astype(float)) ** 2).sum())), i) for i, x, _ in rows if i != q)[:10]
        own = near[near.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == [i for _, i in d] and np.allclose(own.score, [x for x, _ in d]) and own["rank"].tolist() == list(range(1, 11))


def test_vectors_without_components_score_zero(spark):
    df = spark.createDataFrame([(i, [], 0) for i in range(40)] + [(50, [1.0], 0)], SCHEMA)
    got = topk.top_k(df, df.where("vec_id in (0, 3)"), head=4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, i, 0) for i in range(1, 11)] + [(3, i, 0) for i in (0, 1, 2, *range(4, 11))]
    assert ann.search(df, df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("head", [1, 8])
def test_top_k_through_heads_and_floors(spark, head, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    r = np.random.default_rng(5)
    x = np.concatenate([r.exponential(size=(400, 6)) ** 4 * r.choice([-1, 1], (400, 6)), np.zeros((50, 6)), np.ones((50, 6))]).astype(np.float32)
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), head=head).toPandas()
    for q in range(0, 500, 10):
        assert list(got[got.query_id == q].sort_values("rank")[["rank", "vec_id", "score"]].itertuples(index=False, name=None)) == exact_top([x[:2] for x in rows], q, rows[q][1])


def test_sums_beyond_a_long_are_an_error(spark):
    """In the candidates as in the queries; the largest sums that fit are right."""
    kind = "vec_id long, embedding array<double>"
    fits = spark.createDataFrame([(0, [2.0**20, 2.0**20]), (1, [2.0**20, -(2.0**20)]), (2, [2.0**20, 2.0**20])], kind)
    assert [(r.vec_id, r.score) for r in topk.top_k(fits, fits.where("vec_id = 0")).orderBy("rank").collect()] == [(2, 2**61), (1, 0)]
    large = spark.createDataFrame([(3, [2.0**22, 1.0])], kind)
    for vectors, queries in ((fits.union(large), fits), (fits, large), (fits.union(spark.createDataFrame([(4, [1e300, 0.0])], kind)), fits)):
        with pytest.raises(Exception, match="(?s)do not fit|OVERFLOW"):
            topk.top_k(vectors, queries).collect()


def test_heads_stop_skewed_queries():
    r = np.random.default_rng(6)
    share = {}
    for power in (1, 6):
        x = np.floor(1000 * r.exponential(size=(5000, 8)) ** power).astype(np.int64)
        ids = np.arange(len(x))
        few = topk._heads(x, ids, 32)
        rising = np.sort(x[few], axis=0)
        done = scored = 0
        for own in range(0, 5000, 100):
            best, scores, ended = topk._start(x[few], few, (rising[31], rising[-32]), x[own], own, 10)
            others = ids[ids != own]
            rows, exact, n = topk.SortedLists(x).top(x[own], 10, np.array([own]), int(scores[-1]))
            assert rows.tolist() == others[np.lexsort((others, -(x[others] @ x[own])))[:10]].tolist()
            assert not ended or few[best].tolist() == rows.tolist()
            done, scored = done + ended, scored + n
        share[power] = done, scored
    assert share[6][0] > 40 and share[6][1] < share[1][1] / 2


def test_recall(table):
    x, df = table
    got = ann.search(df, df.where("vec_id % 50 = 0")).toPandas()
    hits = total = 0
    for q in range(0, len(x), 50):
        d = np.sqrt(((x.astype(float) - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert np.allclose(own.score, d[own.vec_id]) and len(own) == 10 and own.score.is_monotonic_increasing
        hits, total = hits + len(set(own.vec_id) & set(best)), total + 10
    assert hits / total >= 0.9
    same = got[got.query_id == 1000].sort_values("rank")
    assert same.vec_id.tolist() == list(range(900, 910))  # equal vectors: the smallest ids
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_recall_where_codes_are_coarse(spark):
    x = np.random.default_rng(3).standard_normal((12000, 96)).astype(np.float32)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>").cache()
    got = ann.search(df, df.where("vec_id % 200 = 0")).toPandas()
    hits = 0
    for q in range(0, len(x), 200):
        d = ((x.astype(float) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(got[got.query_id == q].vec_id) & set(np.argsort(d)[:10]))
    assert hits / (60 * 10) >= 0.93


def test_codes_tied_at_the_cut_stay():
    assert ann.smallest(np.array([3.0, 1.0, 2.0, 2.0, 2.0]), 2).tolist() == [1, 2, 3, 4]


def nearest_rows(ids, x, own, k=10):
    """(vec_id, score) of the k nearest by plain loops over components."""
    total = np.zeros(len(x))
    for part in (x.astype(float) - x[own].astype(float)).T:
        total += part * part
    score = np.sqrt(total)
    order = [i for i in np.lexsort((ids, score)) if ids[i] != ids[own]][:k]
    return [(ids[i], score[i]) for i in order]


def other_rows(kind):
    r = np.random.default_rng(7)
    x, asked = r.standard_normal((6000, 48)), np.arange(6000) % 100 == 0
    if kind == "queries in a narrow group":
        group = asked | (r.random(6000) < 0.02)
        x[group] = r.standard_normal(48) + 0.01 * r.standard_normal((group.sum(), 48))
    elif kind == "lengths over many powers":
        x *= np.exp(3 * r.standard_normal((6000, 1)))
    elif kind == "a seventh very long":
        x[3::7] *= 1e15
    elif kind == "far from zero":
        x += 1e6
    elif kind == "many ties":
        x = r.integers(-1, 2, (6000, 10)).astype(float)
    return x.astype(np.float32)


@pytest.mark.parametrize("kind", ["queries in a narrow group", "lengths over many powers", "a seventh very long", "far from zero", "many ties"])
def test_no_near_vector_is_missed_on_other_rows(spark, kind):
    """Rows that no sample of the table speaks for: every query's nearest are exact all the same."""
    x, ids = other_rows(kind), np.arange(6000)
    keep = [i for i in ids if x[i].any()]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in map(int, keep)], "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 100 = 0")).toPandas()
    for own in (i for i, q in enumerate(keep) if q % 100 == 0):
        rows = got[got.query_id == keep[own]].sort_values("rank")
        assert list(zip(rows.vec_id, rows.score)) == nearest_rows(ids[keep], x[keep], own)


def test_near_vectors_through_small_blocks_and_a_poor_start(spark, monkeypatch):
    for name, value in {"LISTS": 1, "CODES": 1, "BLOCK": 50, "QUERY_BLOCK": 7, "AT_ONCE": 3, "CENTROIDS": 2}.items():
        monkeypatch.setattr(ann, name, value)
    r = np.random.default_rng(8)
    x = np.concatenate([r.standard_normal((700, 6)), r.integers(1, 3, (300, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 20 = 0")).toPandas()
    for own in range(0, 1000, 20):
        rows = got[got.query_id == own].sort_values("rank")
        assert list(zip(rows.vec_id, rows.score)) == nearest_rows(np.arange(1000), x, own)


def test_equal_vectors_under_ids_that_repeat(spark):
    """A query whose own id fills its group of equal vectors still finds the group's others."""
    same, rest = [(0, [1.0, 2.0])] * 15 + [(i, [1.0, 2.0]) for i in (4, 5, 6)], [(i, [float(i), 0.0]) for i in range(10, 30)]
    df = spark.createDataFrame(same + rest, "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id in (0, 4)"), k=4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 4), (0, 5), (0, 6), (0, 10), (4, 0), (4, 0), (4, 0), (4, 0)]
