"""The thin queries opN_<name> over the whole test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import ann, exactdup, langid, linededup, mixing, ngramjoin, packing, periodic, pii, sharding, spelling, topk, toxicity
from verdigris.llm.common import table

LEVELS = ["domain", "lang", "source"]
#: Production weights of the mix; any value not named weighs 1.
WEIGHTS = {"domain": {"web": 2, "reference": 3, "forum": 1}, "lang": {"en": 5, "fr": 2, "de": 2}, "source": {"src1": 3, "src2": 2, "src4": 4}}
MIX_EPOCHS, MIX_SEED = 2, 7


def domain_of(source: Column) -> Column:
    """A document's domain from its source: the hot source is the web, sources with an even last digit are reference works."""
    return F.when(source == "src0", "web").when(source.rlike("[02468]$"), "reference").otherwise("forum")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("domain", domain_of(F.col("source")))
    return mixing.mix(docs, LEVELS, WEIGHTS, mixing.word_count(F.col("text")), F.col("all_tokens"), MIX_EPOCHS, MIX_SEED)


def _level_sql(level: str, above: list[str], parent: str) -> str:
    keys = ", ".join([*above, level])
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    weight = "CASE " + level + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"
    joined = f"JOIN {parent} USING ({', '.join(above)})" if above else f"CROSS JOIN {parent}"
    return f"""
{level}_c AS (SELECT {keys}, CAST(sum(tokens) * {MIX_EPOCHS} AS HUGEINT) AS capacity, CAST({weight} AS HUGEINT) AS weight FROM leaves GROUP BY {keys}),
{level}_o AS (SELECT c.*, parent_budget,
  coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
  coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0,
  sum(weight) OVER ({part}) AS w_all, row_number() OVER w AS k
  FROM {level}_c c {joined} WINDOW w AS ({part} ORDER BY capacity / weight, {level})),
{level}_f AS (SELECT *, min(CASE WHEN (parent_budget - c0) * weight <= capacity * (w_all - w0) THEN k END) OVER ({part}) AS first_k FROM {level}_o),
{level}_r AS (SELECT *, max(CASE WHEN k = first_k THEN parent_budget - c0 END) OVER ({part}) AS rest, max(CASE WHEN k = first_k THEN w_all - w0 END) OVER ({part}) AS rest_w, max(CASE WHEN k = first_k THEN w0 END) OVER ({part}) AS w_first FROM {level}_f),
{level}_b AS (SELECT {keys}, CASE WHEN first_k IS NULL OR k < first_k THEN capacity ELSE (rest * (w0 + weight - w_first)) // rest_w - (rest * (w0 - w_first)) // rest_w END AS parent_budget FROM {level}_r)"""


OP1_SQL = f"""
WITH docs AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '[02468]$') THEN 'reference' ELSE 'forum' END AS domain,
  coalesce(lang, '{mixing.MISSING}') AS lang, coalesce(source, '{mixing.MISSING}') AS source,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\x0B]+')), 0) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM docs GROUP BY ALL),
root AS (SELECT CAST(sum(tokens) AS HUGEINT) AS parent_budget FROM leaves),
{_level_sql("domain", [], "root")},
{_level_sql("lang", ["domain"], "domain_b")},
{_level_sql("source", ["domain", "lang"], "lang_b")},
streams AS (SELECT d.*, l.tokens, b.parent_budget AS budget, CAST(unnest(range(0, CAST((b.parent_budget - 1) // l.tokens + 1 AS BIGINT))) AS INTEGER) AS epoch
  FROM docs d JOIN leaves l USING (domain, lang, source) JOIN source_b b USING (domain, lang, source) WHERE b.parent_budget > 0),
placed AS (SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{MIX_SEED}:' || epoch || ':' || doc_id), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM streams)
SELECT doc_id, domain, lang, source, epoch, CAST(start AS BIGINT) AS start, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(least(n_tokens, budget - start) AS BIGINT) AS take_tokens
FROM placed WHERE start < budget
"""


def op2_ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op3_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    kept_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = langid.fit(docs.where(~kept_out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(kept_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "severity", "grade", "p_toxic", "is_toxic")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"))


def op8_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "lines_removed", "text")


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))
    return exactdup.exact_copies(docs, columns=["doc_id", "text_sha256"])


def _misspelt(doc_id: int | None, word: str) -> str:
    """word, for one in 97 by the checksum of id and word without one of its code points; a null id is an empty text."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % 97 else word[:at] + word[at + 1 :]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_forms(spelling.count_words(docs, change=_misspelt))


def _periodic_tail(doc_id: int | None, words: list[str]) -> list[str]:
    """words, for one id in 10 by its checksum repeating a block of them from some word on; a null id changes nothing."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), reword=_periodic_tail)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    digest = F.sha2(F.encode(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), "UTF-8"), 256)
    milli = F.expr("1000 * length div period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", milli, digest.alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op8_threshold_top_k": OP8_SQL, "op11_exact_dedup": OP11_SQL}
