"""Every opN_ query over the smallest tables: its columns and what must hold of its rows."""

import hashlib

import pytest

from verdigris.llm import queries as Q

COLUMNS = {
    "op1_mix_sources": "doc_id bigint, domain string, lang string, source string, epoch int, start bigint, n_tokens bigint, take_tokens bigint",
    "op2_ivf_pq_search": "query_id bigint, rank int, vec_id bigint, score double",
    "op3_label_propagation_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_toxicity": "doc_id bigint, severity double, grade int, p_toxic double, is_toxic boolean",
    "op7_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op8_threshold_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op9_line_dedup": "doc_id bigint, lines_removed int, text string",
    "op10_bootstrapped_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op11_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op12_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op13_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf, name):
    assert set(COLUMNS) == set(Q.queries())
    df = Q.queries()[name](spark, sf)
    kinds = dict(df.dtypes)
    for c in COLUMNS[name].split(", "):
        column, kind = c.split(" ")
        assert kinds.get(column) == kind, c
    got = df.toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    if name in ("op2_ivf_pq_search", "op8_threshold_top_k"):
        assert (got.query_id % 100 == 0).all() and (got.query_id != got.vec_id).all() and not got.duplicated(["query_id", "vec_id"]).any()
        for _, g in got.sort_values("rank").groupby("query_id"):
            assert g["rank"].tolist() == list(range(1, 11)) and (g.score.is_monotonic_increasing if name[2] == "2" else g.score.is_monotonic_decreasing)
    elif name == "op4_best_fit_packing":
        assert set(got.doc_id) == set(docs.doc_id) and got.groupby("sequence_id").length.sum().max() <= 4096
    elif name == "op12_spelling_variants":
        assert got.word.is_unique and (got.n >= 3).all() and (got.word.str.len() >= 5).all() and (got.form.isna() == (got.root == got.word)).all()
    elif name != "op1_mix_sources":
        assert sorted(got.doc_id) == sorted(docs.doc_id)
    if name == "op3_label_propagation_shards":
        counts = got["shard"].value_counts()
        assert len(counts) == 24 and counts.max() - counts.min() <= 1 and got.grown_shard.isna().all()
    elif name == "op5_language_id":
        both = got.merge(docs, on="doc_id")
        known = both[both.lang.notna() & (both.lang_pred != "und")]
        assert (known.lang == known.lang_pred).mean() >= 0.9 and got.score.between(0, 1).all() and 0 < got.held_out.sum() < len(got)
    elif name == "op7_ngram_jaccard_join":
        assert (got.component_id <= got.doc_id).all() and set(got.component_id) <= set(got.doc_id)
    elif name == "op9_line_dedup":
        both = got.merge(docs, on="doc_id")
        assert (both.text_x[both.lines_removed == 0] == both.text_y[both.lines_removed == 0]).all() and (both.text_x.str.len() <= both.text_y.str.len()).all()
    elif name == "op10_bootstrapped_pii":
        base = got.spans.map(lambda s: ",".join(x for x in s.split(",") if not x.startswith("context")))
        assert base.map(lambda s: hashlib.sha256(s.encode()).hexdigest()).tolist() == got.base_sha256.tolist()
        assert (got.n_spans == got.spans.map(lambda s: s.count(":") // 2)).all()
