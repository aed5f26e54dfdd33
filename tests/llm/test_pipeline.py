import glob
import hashlib
import os
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_components, brute_severity

import corpus_pipeline
from verdigris.llm import mixing, toxicity
from verdigris.llm import queries as Q


def test_stages_row_by_row(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(9_000_000)))
    docs.unionByName(extra).coalesce(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = docs.collect()
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)

    # toxicity: what the model's plain sums reject goes, all else stays. The smallest tables have too few labels to learn from.
    learned, smallest = "/root/testdata/sf0.01", docs
    docs = spark.read.parquet(f"{learned}/documents.parquet").where("doc_id < 400").unionByName(extra)
    rows = docs.collect()
    model = toxicity.fit(spark.read.parquet(f"{learned}/documents.parquet"), spark.read.parquet(f"{learned}/labels.parquet"))
    assert model.weights and any(severe_by(model, r.text) for r in rows)
    severe = lambda text: severe_by(model, text)
    clean = corpus_pipeline.toxicity_filter(spark, docs, learned)
    assert clean.columns == docs.columns and key(clean.collect()) == key([r for r in rows if not severe(r.text)])
    assert brute_severity(model, None)[1] == 0
    docs, rows = smallest, smallest.collect()

    # line dedup: no row but those that had words and keep none goes, null ids and texts stay
    lines = corpus_pipeline.line_dedup(spark, docs, sf)
    assert lines.columns == docs.columns
    lines = lines.collect()
    assert sum(r.doc_id is None for r in lines) == 3 and sum(r.text is None for r in lines) == sum(r.text is None for r in rows)
    before = {r.doc_id: r.text for r in rows}
    assert all(r.doc_id is None or r.text is None or len(r.text) <= len(before[r.doc_id]) and r.n_chars in (len(r.text), next(x.n_chars for x in rows if x.doc_id == r.doc_id)) for r in lines)

    # near copies: one document of each group stays
    known = [(r.doc_id, r.text) for r in rows if r.doc_id is not None]
    groups = brute_components(known, 5, 80)
    near = corpus_pipeline.near_copies(spark, docs, sf)
    assert near.columns == docs.columns and key(near.collect()) == key([r for r in rows if r.doc_id is None or groups[r.doc_id][1] == r.doc_id])

    # mix: rows of the table, as many words as the share but for one document a leaf
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert mixed.columns == docs.columns
    mixed = mixed.collect()
    assert not set(key(mixed)) - set(key(rows))
    total, taken = (sum(len((r.text or "").split()) for r in x) for x in (rows, mixed))
    leaves = {(r.lang, r.source) for r in rows}
    longest = max(len((r.text or "").split()) for r in rows)
    assert corpus_pipeline.MIX_SHARE * total - 1 <= taken <= corpus_pipeline.MIX_SHARE * total + len(leaves) * longest

    # packing: each row once
    packed = corpus_pipeline.pack(spark, docs, sf).where("piece = 0").collect()
    assert sorted(repr(r.doc_id) for r in packed) == sorted(repr(r.doc_id) for r in rows)


def plain_split(budget, children):
    """Parts of an integer budget, from (capacity, weight) by name: children that their share fills are full, the others take whole tokens by their weights."""
    order = sorted(children, key=lambda k: (children[k][0] / children[k][1], k))
    out, open_weight = {}, sum(w for _, w in children.values())
    for at, k in enumerate(order):
        capacity, weight = children[k]
        if (budget - sum(out.values())) * weight <= capacity * open_weight:
            rest, upto = budget - sum(out.values()), Fraction(0)
            for k in order[at:]:
                out[k] = rest * (upto + children[k][1]) // open_weight - rest * upto // open_weight
                upto += children[k][1]
            return out
        out[k] = capacity
        open_weight -= weight
    return out


def test_mix_stage_row_by_row(spark, sf):
    """The rows that plain loops take: budgets from level to level, then each leaf's documents in the seeded order. One text has 600,000 words, one is empty, one null, one has no source."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.limit(1)
    odd = [first.withColumns({"doc_id": F.lit(9_000_000 + i).cast("long"), "text": F.lit(t).cast("string")}) for i, t in enumerate(["", None])]
    odd += [first.withColumns({"doc_id": F.lit(9_000_010).cast("long"), "text": F.repeat(F.lit("word "), F.lit(600_000))}), first.withColumns({"doc_id": F.lit(9_000_011).cast("long"), "source": F.lit(None).cast("string")})]
    for more in odd:
        docs = docs.unionByName(more)
    levels = ["domain", "lang", "source"]
    rows = [r.asDict() for r in docs.select("doc_id", "text", Q.domain_of(F.col("source")).alias("domain"), "lang", "source").collect()]
    for r in rows:
        r["n"] = len(r["text"].split()) if r["text"] else 0
        r["path"] = tuple(mixing.MISSING if r[c] is None else r[c] for c in levels)
    weight = lambda level, k: Fraction(str(Q.WEIGHTS.get(levels[level], {}).get(k, 1)))
    is_open = lambda path: all(weight(i, k) > 0 for i, k in enumerate(path))
    tokens = {}
    for r in rows:
        for depth in range(4):
            if depth == 0 or is_open(r["path"]):
                tokens[r["path"][:depth]] = tokens.get(r["path"][:depth], 0) + r["n"]
    budgets = {(): min(int(tokens[()] * corpus_pipeline.MIX_SHARE), sum(t for p, t in tokens.items() if len(p) == 3))}
    for depth in range(3):
        for node in [p for p in budgets if len(p) == depth]:
            children = {p[-1]: (Fraction(t), weight(depth, p[-1])) for p, t in tokens.items() if len(p) == depth + 1 and p[:-1] == node}
            budgets |= {(*node, k): int(b) for k, b in plain_split(budgets[node], children).items()}
    expected = []
    for path in {r["path"] for r in rows}:
        start, budget = 0, budgets.get(path, 0)
        leaf = [r for r in rows if r["path"] == path]
        for r in sorted(leaf, key=lambda r: hashlib.md5(f"{Q.MIX_SEED}:0:{r['doc_id']}".encode()).hexdigest()):
            if start < budget or budget == sum(x["n"] for x in leaf):
                expected.append(r["doc_id"])
            start += r["n"]
    got = corpus_pipeline.mix_sources(spark, docs, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(expected) and 0 < len(expected) < len(rows)
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert all(r.text == texts[r.doc_id] for r in got)


def severe_by(model, text):
    return 1 - brute_mass_of_none(model, text) >= toxicity.REJECT_AT


def brute_mass_of_none(model, text):
    """P(grade = 0) by the sums of brute_severity, through a model of the first threshold alone."""
    return 1 - brute_severity(toxicity.OrdinalModel(model.weights, model.thresholds[:1]), text)[0]


def test_run_leaves_only_the_last_table(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "sequence_id" in out.columns and [os.path.basename(p) for p in glob.glob(os.path.dirname(out._verdigris_path.removeprefix("file://")) + "/*")] == ["best_fit_packing"]


def test_stages_on_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, rel = Q.queries()[name](spark, sf), con.sql(Q.oracle_sql()[name])
    order = lambda columns, rows: sorted(tuple(r[columns.index(c)] for c in sorted(columns)) for r in rows)
    assert order(df.columns, [tuple(r) for r in df.collect()]) == order(rel.columns, rel.fetchall())
