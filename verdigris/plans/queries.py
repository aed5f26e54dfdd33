"""Queries of the evaluation operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import labels as L
from verdigris.functions import text as X
from verdigris.operators import aliases, datasets, diagnostics, grading, metrics, profile, publicnames, sequence, summary, votes
from verdigris.sources import jsonlists, runlog, scratch

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def register(function):
        REGISTRY[function.__name__] = (function, sql)
        return function

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# -- votes -----------------------------------------------------------------

def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of runs: a cell is a user's day, events are its runs in order."""
    return t(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "event_type")


_VOTE = """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY ALL"""


@query(f"WITH c AS ({_VOTE}) SELECT user_id, day, event_type AS vote, n AS n_votes FROM c QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, lo) = 1")
def a1_majority_vote(spark, sf_dir):
    return votes.majority_vote(runs(spark, sf_dir), ["user_id", "day"], "event_type", "event_id")


@query("""WITH k AS (SELECT DISTINCT user_id FROM events), c AS (SELECT user_id, event_type, count(*) n, min(event_id) lo FROM events WHERE event_type = 'error' AND value > 95 GROUP BY ALL)
SELECT k.user_id, coalesce(v.event_type, '') AS vote, CAST(coalesce(v.n, 0) AS BIGINT) AS n_votes FROM k LEFT JOIN (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, lo) = 1) v USING (user_id)""")
def a1_vote_of_all_keys(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    return votes.majority_vote(events.where("event_type = 'error' AND value > 95"), ["user_id"], "event_type", "event_id", all_keys=events)


def rounds(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.get_json_object("props", "$.k").cast("int") % 3).cast("string").alias("k"))
    return e.select("user_id", "event_type", F.concat(F.lit(" "), "k", F.lit(" ")).alias("label"), (F.col("event_id") % 5).alias("round"), "event_id")


_ROUNDS = "SELECT user_id, event_type, CAST(CAST(json_extract_string(props, '$.k') AS INT) % 3 AS VARCHAR) AS label, event_id FROM events"


@query(f"WITH r AS ({_ROUNDS}), c AS (SELECT user_id, event_type, label, count(*) n, min(event_id) lo FROM r GROUP BY ALL) SELECT user_id, event_type, label AS vote, n AS n_votes FROM c QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY n DESC, lo) = 1")
def a2_vote_over_rounds(spark, sf_dir):
    return votes.vote_over_rounds(rounds(spark, sf_dir), ["user_id", "event_type"], "label", "event_id")


@query("""WITH c AS (SELECT c_custkey, c_mktsegment FROM customer), v AS (SELECT o_custkey, o_orderpriority p, count(*) n, min(o_orderkey) lo FROM orders WHERE o_totalprice > 200000 GROUP BY ALL),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, lo) = 1)
SELECT c_custkey, coalesce(p, c_mktsegment) AS vote, CAST(coalesce(n, 0) AS BIGINT) AS n_votes FROM c LEFT JOIN w ON o_custkey = c_custkey""")
def a2_vote_keeps_base(spark, sf_dir):
    base = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"))
    given = t(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("round"))
    return votes.vote_over_rounds(given, ["c_custkey"], "label", "round", base)


@query(f"WITH r AS ({_ROUNDS}), c AS (SELECT user_id, event_type, min(label) lo, max(label) hi FROM r GROUP BY ALL) SELECT event_type, count(*) AS n_cells, count(*) FILTER (lo <> hi) AS n_disagree FROM c GROUP BY 1")
def a3_disagreement(spark, sf_dir):
    return votes.disagreement(rounds(spark, sf_dir), ["user_id", "event_type"], "label", ["event_type"])


@query("SELECT conv_id, count(DISTINCT role) AS n_distinct, count(DISTINCT role) <= 1 AS unanimous FROM conversations GROUP BY 1")
def a4_unanimity(spark, sf_dir):
    return votes.unanimity(t(spark, sf_dir, "conversations"), ["conv_id"], "role")


# -- labels ----------------------------------------------------------------

def answers(spark, sf_dir) -> DataFrame:
    """Answers of every form: plain, padded, upper case, empty, unknown, without bracket, broken over lines, missing."""
    e = t(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id") % 10
    forms = ["[Correct]", " said [ partially correct ] then [wrong]", "[REASONING WRONG]", "[]", "[maybe]", "no bracket", "[wro\nng]", "[Wrong]", "'[It''s]'"]
    answer = F.when(k == 0, forms[0])
    for i, f in enumerate(forms[1:], 1):
        answer = answer.when(k == i, f)
    return e.withColumn("answer", answer)


_ANSWERS = """SELECT event_id, CASE event_id % 10 WHEN 0 THEN '[Correct]' WHEN 1 THEN ' said [ partially correct ] then [wrong]' WHEN 2 THEN '[REASONING WRONG]' WHEN 3 THEN '[]' WHEN 4 THEN '[maybe]' WHEN 5 THEN 'no bracket'
WHEN 6 THEN '[wro' || chr(10) || 'ng]' WHEN 7 THEN '[Wrong]' WHEN 8 THEN '''[It''''s]''' END AS answer FROM events"""


@query(f"""WITH a AS ({_ANSWERS}), b AS (SELECT event_id, coalesce(answer, 'None') a FROM a), c AS (SELECT *, regexp_matches(a, '\\[[^\\n]*?\\]') has, lower(trim(regexp_extract(a, '\\[([^\\n]*?)\\]', 1))) w FROM b)
SELECT event_id, CASE WHEN NOT has THEN 'Cannot extract detection labels: ' || a WHEN w = 'correct' THEN '[Correct]' WHEN w = 'partially correct' THEN '[Partially correct]' WHEN w = 'reasoning wrong' THEN '[Reasoning Wrong]' WHEN w = 'wrong' THEN '[Wrong]' ELSE 'Cannot verify: ' || a END AS grade FROM c""")
def p1_normalize_grade(spark, sf_dir):
    return answers(spark, sf_dir).select("event_id", L.normalize_grade(F.col("answer")).alias("grade"))


@query(f"WITH a AS ({_ANSWERS}) SELECT event_id, lower(trim(replace(replace(answer, '[', ''), ']', ''), '''')) AS bare, lower(replace(replace(replace(answer, '[', ''), ']', ''), '''', '')) AS unquoted FROM a")
def p2_p3_bare_grades(spark, sf_dir):
    return answers(spark, sf_dir).select("event_id", L.bare_grade(F.col("answer")).alias("bare"), L.bare_grade_unquoted(F.col("answer")).alias("unquoted"))


def keyed(spark, sf_dir) -> DataFrame:
    """Instance keys from parts: library by brand, number by size, status by key."""
    p = t(spark, sf_dir, "part")
    status = F.when(F.col("p_partkey") % 3 == 0, "fixed").when(F.col("p_partkey") % 3 == 1, "reproduced").otherwise("unknown")
    return p.select("p_partkey", F.concat_ws("_", F.replace("p_brand", F.lit("#"), F.lit("")), F.col("p_size").cast("string"), status).alias("instance"))


_KEYED = "SELECT p_partkey, replace(p_brand, '#', '') || '_' || p_size || '_' || CASE p_partkey % 3 WHEN 0 THEN 'fixed' WHEN 1 THEN 'reproduced' ELSE 'unknown' END AS instance FROM part"


@query(f"WITH k AS ({_KEYED}) SELECT p_partkey, replace(replace(instance, '_reproduced', ''), '_fixed', '') AS base, split_part(instance, '_', 1) || '_' || split_part(instance, '_', 2) AS case_name, split_part(instance, '_', 1) AS library FROM k WHERE NOT ends_with(instance, '_fixed')")
def p4_p5_p16_p17_keys(spark, sf_dir):
    k = keyed(spark, sf_dir).where(L.is_crashing_twin(F.col("instance")))
    i = F.col("instance")
    return k.select("p_partkey", L.base_instance(i).alias("base"), L.case_of(i).alias("case_name"), L.library_of(i).alias("library"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN '' WHEN doc_id % 7 = 2 THEN 'None' WHEN doc_id % 7 = 3 THEN 'seaborn' WHEN doc_id % 7 = 4 THEN 'library cause' ELSE lang END AS cause FROM documents),
f AS (SELECT doc_id, cause, CASE WHEN cause IS NULL OR cause IN ('None', '') THEN 'NBspecific' WHEN cause IN ('lightgbm', 'matplotlib', 'seaborn', 'statsmodels', 'torchvision') THEN 'other' ELSE cause END AS filled FROM d)
SELECT doc_id, filled, CASE WHEN cause = 'library cause' THEN 'deprecated API' ELSE cause END AS shown, cause AS stored FROM f""")
def p6_p7_p8_p9_causes(spark, sf_dir):
    k = F.col("doc_id") % 7
    cause = F.when(k == 0, None).when(k == 1, "").when(k == 2, "None").when(k == 3, "seaborn").when(k == 4, "library cause").otherwise(F.col("lang"))
    d = t(spark, sf_dir, "documents").select("doc_id", cause.alias("label")).withColumnRenamed("label", "cause")
    return d.select("doc_id", L.library_cause(F.col("cause")).alias("filled"), L.shown_cause(F.col("cause")).alias("shown"), L.stored_cause(L.shown_cause(F.col("cause"))).alias("stored"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 10 THEN p_name[:10] || '...' ELSE p_name END AS short FROM part")
def p18_truncate(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", L.truncated(F.col("p_name"), 10).alias("short"))


# -- joins -----------------------------------------------------------------

def _human(spark, sf_dir):
    return t(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.col("lang"), F.col("source"), (F.col("n_chars") % 2).cast("int").alias("quality"))


@query("""WITH h AS (SELECT doc_id, lang, source, CAST(n_chars % 2 AS INT) AS quality FROM documents WHERE lang = 'en')
SELECT coalesce(h.doc_id, l.doc_id) AS doc_id, lang, source, h.quality AS quality_human, l.quality AS quality_llm, toxic, coalesce(h.quality = l.quality, false) AS match FROM h FULL JOIN labels l ON h.doc_id = l.doc_id""")
def j1_p10_outer_with_match(spark, sf_dir):
    both = summary.suffixed_outer(_human(spark, sf_dir), t(spark, sf_dir, "labels"), "doc_id", ("_human", "_llm"))
    return summary.match_flags(both, "quality_human", "quality_llm")


@query("""WITH h AS (SELECT doc_id, lang, source, CAST(n_chars % 2 AS INT) AS quality FROM documents WHERE lang = 'en'), s AS (SELECT doc_id, lang, length(text) AS quality FROM documents WHERE source <> 'src0'),
a AS (SELECT coalesce(h.doc_id, l.doc_id) AS doc_id, lang, source, h.quality AS quality_human, l.quality AS quality_llm, toxic FROM h FULL JOIN labels l ON h.doc_id = l.doc_id)
SELECT coalesce(a.doc_id, s.doc_id) AS doc_id, a.lang, source, quality_human, quality_llm, toxic, s.lang AS lang_sas, s.quality FROM a FULL JOIN s ON a.doc_id = s.doc_id""")
def j2_outer_of_three(spark, sf_dir):
    first = summary.suffixed_outer(_human(spark, sf_dir), t(spark, sf_dir, "labels"), "doc_id", ("_human", "_llm"))
    third = t(spark, sf_dir, "documents").where("source <> 'src0'").select("doc_id", "lang", F.length("text").cast("long").alias("quality"))
    return summary.suffixed_outer(first, third, "doc_id", ("", "_sas"))


@query("SELECT d.doc_id, lang, source, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j3_inner(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(t(spark, sf_dir, "labels"), "doc_id")


@query("""WITH o AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE quality END AS q FROM labels), v AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic END AS q FROM labels)
SELECT o.doc_id, o.q AS q_orig, v.q AS q_reversed, coalesce(o.q = v.q, false) AS match FROM o JOIN v USING (doc_id) WHERE o.q IS NOT NULL""")
def j4_p11_orig_reversed(spark, sf_dir):
    lab = t(spark, sf_dir, "labels")
    o = lab.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("quality")).alias("q"))
    v = lab.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("toxic")).alias("q"))
    return summary.match_flags(summary.suffixed_inner(o, v, "doc_id", ("_orig", "_reversed"), ["q"]), "q_orig", "q_reversed")


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j5_label_join(spark, sf_dir):
    nation = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("""WITH s AS (SELECT l_orderkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, l_orderkey) AS orderkey, o_orderstatus, q FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F') o FULL JOIN s ON o_orderkey = l_orderkey""")
def j6_full_outer(spark, sf_dir):
    s = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    o = t(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("orderkey"), "o_orderstatus")
    return summary.suffixed_outer(o, s, "orderkey", ("_o", "_s"))


@query("""WITH u AS (SELECT o_custkey, min(o_orderpriority) p FROM orders GROUP BY 1 HAVING count(*) = 1)
SELECT c_custkey, coalesce(p, '') AS diagnosis FROM customer LEFT JOIN u ON o_custkey = c_custkey""")
def j7_unique_lookup(spark, sf_dir):
    truth = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("diagnosis"))
    return summary.looked_up(t(spark, sf_dir, "customer").select("c_custkey"), truth, "c_custkey", "diagnosis")


@query("""WITH u AS (SELECT o_custkey, max(o_orderstatus) s FROM orders WHERE o_totalprice > 300000 GROUP BY 1)
SELECT c_custkey, coalesce(s, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN u ON o_custkey = c_custkey""")
def j8_scatter(spark, sf_dir):
    new = t(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("c_mktsegment"))
    return summary.scattered(t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), new, "c_custkey", "c_mktsegment")


@query("""WITH u AS (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS p, bool_or(o_orderstatus = 'O') AS d FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN n = 1 THEN chr(10) || 'Ground truth: ' || CASE WHEN d THEN 'True' ELSE 'False' END || '. ' || CASE WHEN d THEN p ELSE '' END ELSE '' END AS ground_truth FROM customer LEFT JOIN u ON o_custkey = c_custkey""")
def j7_ground_truth_text(spark, sf_dir):
    buggy = F.col("o_orderstatus") == "O"
    truth = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), buggy.alias("detection"), F.when(buggy, F.col("o_orderpriority")).alias("diagnosis"))
    return summary.with_ground_truth(t(spark, sf_dir, "customer").select("c_custkey"), truth, "c_custkey", "detection", "diagnosis")


def _alias_map(spark, sf_dir):
    n = t(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0")
    return n.select(F.lit("geo").alias("package"), F.concat(F.lit("geo."), "n_name").alias("internal"), F.concat(F.lit("geo.R"), F.col("n_regionkey").cast("string")).alias("public"))


@query("""WITH m AS (SELECT 'geo.' || n_name AS internal, 'geo.R' || n_regionkey AS public FROM nation WHERE n_nationkey % 3 <> 0),
s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'geo.R1' ELSE 'geo.' || n_name END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, name, CASE WHEN name IN (SELECT public FROM m) THEN name ELSE coalesce(m.public, name) END AS public FROM s LEFT JOIN m ON name = internal""")
def j9_alias_lookup(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, "geo.R1").otherwise(F.concat(F.lit("geo."), "n_name")).alias("name"))
    return aliases.public_names(s, _alias_map(spark, sf_dir), "name")


@query("""WITH p AS (SELECT p_partkey, replace(p_type, ' ', '.') || '.x.' || p_size AS kind FROM part), m AS (SELECT DISTINCT replace(p_type, ' ', '.') AS module, 'a' || length(p_type) AS alias FROM part WHERE p_type <> (SELECT min(p_type) FROM part)
UNION SELECT DISTINCT replace(p_type, ' ', '.') || '.x', 'bx' FROM part WHERE p_size < 20 AND length(p_type) % 2 = 0),
j AS (SELECT p_partkey, kind, module, alias FROM p LEFT JOIN m ON kind = module OR starts_with(kind, module || '.')),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(module) DESC NULLS LAST) = 1)
SELECT p_partkey, kind, CASE WHEN module IS NULL THEN kind ELSE alias || substr(kind, length(module) + 1) END AS matched FROM b""")
def j10_longest_prefix(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    kind = F.replace("p_type", F.lit(" "), F.lit("."))
    first = part.agg(F.min("p_type").alias("least"))
    m = part.join(F.broadcast(first), F.col("p_type") != F.col("least")).select(kind.alias("module"), F.concat(F.lit("a"), F.length("p_type").cast("string")).alias("alias"))
    m = m.union(part.where("p_size < 20 AND length(p_type) % 2 = 0").select(F.concat(kind, F.lit(".x")), F.lit("bx"))).distinct()
    rows = part.select("p_partkey", F.concat(kind, F.lit(".x."), F.col("p_size").cast("string")).alias("kind"))
    return aliases.longest_prefix(rows, ["p_partkey"], "kind", m)


@query(f"""WITH c AS ({_VOTE}), a AS (SELECT user_id, day, event_type v FROM c QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, lo) = 1), b AS (SELECT user_id, day, event_type v FROM c QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, hi DESC) = 1)
SELECT user_id, day, a.v AS first_vote, b.v AS last_vote, a.v = b.v AS match FROM a JOIN b USING (user_id, day)""")
def j11_j12_aligned_by_key(spark, sf_dir):
    return summary.match_flags(_two_orders(spark, sf_dir), "first_vote", "last_vote")


def _two_orders(spark, sf_dir) -> DataFrame:
    r, k = runs(spark, sf_dir), ["user_id", "day"]
    a = votes.majority_vote(r, k, "event_type", "event_id").select(*k, F.col("vote").alias("first_vote"))
    b = votes.majority_vote(r, k, "event_type", "event_id", last_wins=True).select(*k, F.col("vote").alias("last_vote"))
    return a.join(b, k)


# -- metrics ---------------------------------------------------------------

def _pairs(spark, sf_dir) -> DataFrame:
    lab = t(spark, sf_dir, "labels")
    q = lab.select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("quality")).alias("quality"), F.when(F.col("doc_id") % 13 != 0, F.col("toxic")).alias("toxic"))
    return t(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(q, "doc_id")


_PAIRS = "SELECT d.doc_id, lang, source, CASE WHEN d.doc_id % 11 <> 0 THEN quality END AS quality, CASE WHEN d.doc_id % 13 <> 0 THEN toxic END AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


@query(f"WITH p AS ({_PAIRS}), c AS (SELECT lang, count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL) AS n, count(*) FILTER (quality <> toxic) AS mismatches FROM p GROUP BY 1) SELECT lang, n, mismatches, round(CASE WHEN n = 0 THEN 0 ELSE (n - mismatches) / n END, 6) AS accuracy FROM c")
def a5_accuracy(spark, sf_dir):
    return metrics.accuracy(_pairs(spark, sf_dir), ["lang"], "quality", "toxic").withColumn("accuracy", r6(F.col("accuracy")))


@query(f"WITH p AS ({_PAIRS}) SELECT lang, count(*) AS n, count(*) FILTER (quality = toxic) AS matches, round(count(*) FILTER (quality = toxic) / count(*), 6) AS rate FROM p WHERE quality IS NOT NULL GROUP BY 1")
def a6_agreement(spark, sf_dir):
    return metrics.agreement(_pairs(spark, sf_dir), ["lang"], "quality", "toxic").withColumn("rate", r6(F.col("rate")))


@query(f"WITH p AS ({_PAIRS}), c AS (SELECT count(*) AS cells, count(*) FILTER (quality = toxic) AS matches, count(DISTINCT doc_id) AS k FROM p) SELECT cells, matches, round(matches / cells, 6) AS overall, round((matches + k) / (cells + k), 6) AS overall_with_keys FROM c")
def a7_overall_agreement(spark, sf_dir):
    out = metrics.overall_agreement(_pairs(spark, sf_dir), "doc_id", "quality", "toxic")
    return out.withColumn("overall", r6(F.col("overall"))).withColumn("overall_with_keys", r6(F.col("overall_with_keys")))


@query(f"""WITH p AS ({_PAIRS}) SELECT lang, source, count(*) AS n, round(count(*) FILTER (quality = 1) / count(*), 6) AS with_rate, round(count(*) FILTER (toxic = 1) / count(*), 6) AS without_rate,
round(count(*) FILTER (quality = 1) / count(*) - count(*) FILTER (toxic = 1) / count(*), 6) AS improvement FROM p GROUP BY 1, 2 HAVING count(*) >= 5""")
def a8_a9_rates_by_cause(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("quality", F.col("quality").cast("string")).withColumn("toxic", F.col("toxic").cast("string"))
    out = metrics.rates_by_cause(p, ["lang", "source"], "quality", "toxic", "1")
    return out.select("lang", "source", "n", *[r6(F.col(c)).alias(c) for c in ("with_rate", "without_rate", "improvement")])


def _kappa_sql(by: str) -> str:
    g, using = (f"{by}, ", f"USING ({by}, k)") if by else ("", "USING (k)")
    on = f"JOIN e USING ({by})" if by else "CROSS JOIN e"
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH p AS (SELECT * FROM ({_PAIRS}) WHERE quality IS NOT NULL AND toxic IS NOT NULL), h AS (SELECT {g} quality AS k, count(*) n FROM p GROUP BY ALL), j AS (SELECT {g} toxic AS k, count(*) n FROM p GROUP BY ALL),
e AS (SELECT {g} CAST(sum(coalesce(h.n, 0) * coalesce(j.n, 0)) AS DOUBLE) AS x FROM h FULL JOIN j {using} {group}), o AS (SELECT {g} count(*) AS n, count(*) FILTER (quality = toxic) AS agreed FROM p {group})
SELECT {g} n, agreed, round(CASE WHEN x = CAST(n AS DOUBLE) * n THEN NULL ELSE (agreed / n - x / (CAST(n AS DOUBLE) * n)) / (1 - x / (CAST(n AS DOUBLE) * n)) END, 6) AS kappa FROM o {on}"""


@query(_kappa_sql(""))
def a10_kappa(spark, sf_dir):
    return metrics.kappa(_pairs(spark, sf_dir), [], "quality", "toxic").withColumn("kappa", r6(F.col("kappa")))


@query(_kappa_sql("lang"))
def a10_kappa_by_lang(spark, sf_dir):
    return metrics.kappa(_pairs(spark, sf_dir), ["lang"], "quality", "toxic").withColumn("kappa", r6(F.col("kappa")))


@query("SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY 1")
def a11_first_seen(spark, sf_dir):
    return summary.first_seen(t(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def a12_a13_value_counts(spark, sf_dir):
    return metrics.value_counts(t(spark, sf_dir, "part"), "p_type")


@query("SELECT 'geo' AS package, count(*) AS n FROM nation WHERE n_nationkey % 3 <> 0")
def a13_alias_totals(spark, sf_dir):
    return aliases.totals(_alias_map(spark, sf_dir))


@query("SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def a14_case_count(spark, sf_dir):
    return t(spark, sf_dir, "events").where("event_type = 'error'").agg(F.count("*").alias("n"))


# -- pivots, unions, orders --------------------------------------------------

KINDS = ["click", "error", "login", "purchase", "view"]


@query("""WITH c AS (SELECT user_id, event_type, count(*) n FROM events GROUP BY ALL)
SELECT user_id, """ + ", ".join(f"max(n) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + " FROM c GROUP BY 1")
def o1_pivot(spark, sf_dir):
    c = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return summary.pivoted(c, ["user_id"], "event_type", KINDS, "n", "n")


@query("""SELECT c_custkey, coalesce(b.v, a.v) AS v FROM (SELECT c_custkey, c_mktsegment v FROM customer) a FULL JOIN (SELECT o_custkey c_custkey, max(o_orderpriority) v FROM orders GROUP BY 1) b USING (c_custkey)""")
def o2_union_last_wins(spark, sf_dir):
    a = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    b = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("v"))
    return summary.union_last_wins([a, b], ["c_custkey"])


@query("SELECT doc_id, 'quality' AS column_name, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def o3_o9_unpivot(spark, sf_dir):
    return summary.unpivoted(t(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"], "column_name", "value")


@query(f"""WITH k AS ({_KEYED}) SELECT p_partkey, instance, row_number() OVER (PARTITION BY split_part(instance, '_', 1) ORDER BY CASE split_part(instance, '_', 3) WHEN 'fixed' THEN 0 WHEN 'reproduced' THEN 1 ELSE 99 END, CAST(split_part(instance, '_', 2) AS INT), p_partkey) AS position FROM k""")
def o4_instance_order(spark, sf_dir):
    k = keyed(spark, sf_dir).withColumn("_l", L.library_of(F.col("instance")))
    return summary.positioned(k, [*L.instance_order(F.col("instance")), F.col("p_partkey")], partitions=["_l"]).drop("_l")


@query("""WITH s AS (SELECT event_type, min(event_id) f FROM events GROUP BY 1) SELECT event_type, row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 2147483647 END, f) AS position FROM s""")
def o5_listed_order(spark, sf_dir):
    s = summary.first_seen(t(spark, sf_dir, "events"), "event_type", "event_id")
    return summary.positioned(s, L.listed_order(F.col("event_type"), F.col("first_seen"), ["purchase", "absent", "error"])).select("event_type", "position")


@query("SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey) AS position FROM orders")
def o5_whole_table_positions(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return summary.positioned(o, [F.col("o_orderstatus").desc(), F.col("o_totalprice"), F.col("o_orderkey")]).drop("o_totalprice")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS run FROM events GROUP BY 1")
def o6_ordered_list(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), ",").alias("run"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def o7_sorted_set(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT n_nationkey AS nationkey FROM nation UNION SELECT c_nationkey FROM customer")
def o8_set_union(spark, sf_dir):
    return t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationkey")).union(t(spark, sf_dir, "customer").select("c_nationkey")).distinct()


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 5")
def o10_top_k(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", "user_id").orderBy("event_id").limit(5)


@query("SELECT event_id, event_type FROM events WHERE event_id <= 222")
def s5_head_by_position(spark, sf_dir):
    return summary.head_by_position(t(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 222)


# -- the log of runs ---------------------------------------------------------

@query("""SELECT CAST(user_id AS VARCHAR) AS instance, event_type AS model, 't' AS task, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN value > 50 THEN 0 WHEN value > 20 THEN 1 ELSE 2 END, event_id) - 1 AS run FROM events""")
def k3_append_runs(spark, sf_dir):
    """Three batches, of which one is tried twice and the first two are made one."""
    e = t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("instance"), F.col("event_type").alias("model"), F.lit("t").alias("task"), F.col("value"), "event_id")
    path = scratch.new_folder(spark, "runs")
    for token, rows in (("high", "value > 50"), ("middle", "value <= 50 AND value > 20"), ("high", "value > 50")):
        runlog.append_runs(e.where(rows), path, token, "event_id")
    runlog.compact(spark, path, "both")
    runlog.append_runs(e.where("value <= 20"), path, "low", "event_id")
    return runlog.read_runs(spark, path).select("instance", "model", "task", "event_id", "run")


@query("""WITH j AS (SELECT event_id, '[{"detection": ' || CASE event_id % 5 WHEN 0 THEN CASE WHEN value > 50 THEN 'true' ELSE 'false' END WHEN 1 THEN '"true"' WHEN 2 THEN '1' WHEN 3 THEN 'null' ELSE '{}' END || '}, "say true", true, 1.5, [1], null]' AS j FROM events),
e AS (SELECT event_id, CAST(unnest(range(CAST(json_array_length(j) AS BIGINT))) AS INTEGER) AS pos, j FROM j), i AS (SELECT event_id, pos, json_extract(j, '$[' || pos || ']') AS item FROM e),
k(said, kind) AS (VALUES ('OBJECT', 'object'), ('ARRAY', 'array'), ('VARCHAR', 'string'), ('BOOLEAN', 'boolean'), ('NULL', 'null'), ('UBIGINT', 'number'), ('DOUBLE', 'number'))
SELECT event_id, pos, a.kind, b.kind AS field, CASE WHEN b.kind = 'boolean' THEN CAST(item->>'$.detection' AS BOOLEAN) END AS detection, CASE WHEN a.kind = 'string' THEN item->>'$' END AS raw
FROM i LEFT JOIN k a ON a.said = json_type(item) LEFT JOIN k b ON b.said = json_type(item, '$.detection')""")
def s1_mixed_items(spark, sf_dir):
    """Items that are objects or raw texts, their fields by type."""
    n, e = F.col("event_id") % 5, t(spark, sf_dir, "events")
    said = F.when(n == 0, (F.col("value") > 50).cast("string")).when(n == 1, '"true"').when(n == 2, "1").when(n == 3, "null").otherwise("{}")
    lists = e.select("event_id", F.concat(F.lit('[{"detection": '), said, F.lit('}, "say true", true, 1.5, [1], null]')).alias("value"))
    items = jsonlists.items_of(lists, "value")
    return items.select("event_id", "pos", jsonlists.kind_of(F.col("item")).alias("kind"), jsonlists.field_kind(F.col("item"), "detection").alias("field"), jsonlists.boolean_field(F.col("item"), "detection").alias("detection"), jsonlists.raw_text(F.col("item")).alias("raw"))


# -- profiles --------------------------------------------------------------

def _range_sql(table: str, column: str, kind: str, names: dict[str, str]) -> str:
    """kind: i (integer), f (fraction) or s (other)."""
    d = f"count(DISTINCT {column})"
    dtype = {"i4": "int", "i8": "bigint", "f": "double", "s": "string"}[kind]
    if kind == "s":
        label, low, high, shown = f"'{names['other']}'", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)"
    else:
        binary = f"({d} = 2 AND count(*) FILTER ({column} NOT IN (0, 1)) = 0)"
        few = f"WHEN {d} <= 10 THEN '{names['few']}' " if kind != "f" else ""
        label = f"CASE WHEN {binary} THEN '{names['binary']}' {few}ELSE '{names['continuous']}' END"
        low, high, shown = f"CAST(min({column}) AS DOUBLE)", f"CAST(max({column}) AS DOUBLE)", f"CASE WHEN {binary} THEN '0,1' END"
    return f"SELECT '{column}' AS column_name, '{dtype}' AS dtype, {label} AS type, {d} AS num_unique, {low} AS low, {high} AS high, count(*) > count({column}) AS has_nan, count(*) AS length, {shown} AS shown FROM {table}"


_PROFILED = {"part": {"p_partkey": "i8", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i4", "p_retailprice": "f"}, "labels": {"doc_id": "i8", "quality": "i4", "toxic": "i4"}}


@query(" UNION ALL ".join(_range_sql("part", c, k, profile.COLUMN_NAMES) for c, k in _PROFILED["part"].items()))
def f7_column_profile(spark, sf_dir):
    return profile.column_profile(t(spark, sf_dir, "part")).withColumnRenamed("column", "column_name")


@query(" UNION ALL ".join(_range_sql("labels", c, k, profile.RANGE_NAMES) for c, k in _PROFILED["labels"].items()))
def f3_value_ranges(spark, sf_dir):
    return profile.column_profile(t(spark, sf_dir, "labels"), names=profile.RANGE_NAMES).withColumnRenamed("column", "column_name")


def _values_sql(table: str, column: str) -> str:
    text = f"CASE WHEN length(CAST({column} AS VARCHAR)) > 20 THEN left(CAST({column} AS VARCHAR), 20) || '...' ELSE CAST({column} AS VARCHAR) END"
    return f"SELECT '{column}' AS column_name, (SELECT string_agg(v, ',' ORDER BY k) FROM (SELECT DISTINCT {column} AS k, {text} AS v FROM {table} WHERE {column} IS NOT NULL ORDER BY {column} LIMIT 5)) AS v, (SELECT count(DISTINCT {column}) FROM {table}) AS n"


@query("WITH v AS (" + " UNION ALL ".join(_values_sql("part", c) for c in ("p_name", "p_brand", "p_type", "p_size")) + ") SELECT column_name, n AS num_unique, CASE WHEN n <= 5 AND column_name <> 'p_size' THEN v END AS unique_values, CASE WHEN n > 5 AND column_name <> 'p_size' THEN v END AS example_values FROM v")
def f7_values(spark, sf_dir):
    out = profile.with_values(t(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type", "p_size"])
    return out.select(F.col("column").alias("column_name"), "num_unique", "unique_values", "example_values")


@query("WITH f AS (SELECT quality, (doc_id % 3 + 9) * 5 AS third, 'c' || doc_id % 4 AS name FROM labels), v AS (" + " UNION ALL ".join(_values_sql("f", c) for c in ("quality", "third", "name")) + ") SELECT column_name, n AS num_unique, v AS unique_values FROM v")
def f3_values(spark, sf_dir):
    lab = t(spark, sf_dir, "labels").select("quality", ((F.col("doc_id") % 3 + 9) * 5).alias("third"), F.concat(F.lit("c"), (F.col("doc_id") % 4).cast("string")).alias("name"))
    return profile.with_values(lab, names=profile.RANGE_NAMES).select(F.col("column").alias("column_name"), "num_unique", "unique_values")


_RULED = {"c_custkey": "integer", "c_name": "text", "c_nationkey": "integer", "c_acctbal": "fraction", "c_mktsegment": "text", "positive": "boolean"}


def _ruled_sql(column: str, kind: str) -> str:
    number, c = kind in ("integer", "fraction", "boolean"), column
    n = f"CAST({c} AS DOUBLE)"
    facts = {"dtype": f"max('{ {'integer': 'int' if c == 'c_nationkey' else 'bigint', 'text': 'string', 'fraction': 'double', 'boolean': 'boolean'}[kind] }')", "num_unique": f"CAST(count(DISTINCT {c}) AS VARCHAR)", "has_nan": f"CAST(count(*) > count({c}) AS VARCHAR)", "missing": f"CAST(count(*) - count({c}) AS VARCHAR)"}
    few = f"WHEN count(DISTINCT {c}) <= 10 THEN '{profile.RANGE_NAMES['few']}'" if kind == "integer" else ""
    facts["type"] = f"CASE WHEN count(DISTINCT {c}) = 2 AND count(*) FILTER ({n} NOT IN (0, 1)) = 0 THEN 'binary' {few} ELSE 'continuous' END" if number else f"max('{profile.RANGE_NAMES['other']}')"
    if kind == "text":
        facts |= {"shortest": f"CAST(min(length({c})) AS VARCHAR)", "longest": f"CAST(max(length({c})) AS VARCHAR)"}
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS key, {v} AS value FROM f" for k, v in facts.items())


@query("WITH f AS (SELECT *, c_acctbal > 0 AS positive FROM customer) " + " UNION ALL ".join(_ruled_sql(c, k) for c, k in _RULED.items()))
def s10_rules_in_one_scan(spark, sf_dir):
    table = t(spark, sf_dir, "customer").withColumn("positive", F.col("c_acctbal") > 0)
    out = profile.apply_rules(table, ["summarize_columns", "summarize_nulls", "summarize_ranges", "summarize_texts"])
    return out.where("key NOT IN ('low', 'high')").withColumnRenamed("column", "column_name")


@query("SELECT 'series' AS type, (SELECT lower(column_type) FROM (DESCRIBE part) WHERE column_name = 'p_retailprice') AS dtype, count(*) AS length, count(*) > count(p_retailprice) AS has_nan FROM part")
def f4_series(spark, sf_dir):
    return profile.series(t(spark, sf_dir, "part"), "p_retailprice")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN event_type WHEN 2 THEN CASE WHEN value > 50 THEN 'true' ELSE 'false' END END AS value FROM events""")
def f1_primitive(spark, sf_dir):
    k, e = F.col("event_id") % 5, t(spark, sf_dir, "events")
    given = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(k == 2, (F.col("value") > 50).cast("string")).when(k == 3, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))).otherwise(F.col("props"))
    return e.select("event_id", profile.primitive_value(given).alias("value"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS length, '(' || len(embedding) || ')' AS shape FROM embeddings")
def f2_collection(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", profile.collection_length(F.col("embedding")).alias("length"), profile.shape_of(F.col("embedding")).alias("shape"))


@query("SELECT vec_id, CAST(len(embedding) + CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS length, vec_id % 10 = 0 AS has_nan, CAST(list_min(embedding) AS DOUBLE) AS low, CAST(list_max(embedding) AS DOUBLE) AS high, false AS empty FROM embeddings")
def f5_array(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    hurt = F.when(F.col("vec_id") % 10 == 0, F.concat(F.slice("embedding", 2, 100), F.array(F.lit(float("nan")).cast("float")), F.slice("embedding", 1, 1))).otherwise(F.col("embedding"))
    return e.select("vec_id", profile.array_profile(hurt).alias("p")).select("vec_id", "p.*")


@query("SELECT vec_id, '(2, ' || len(embedding) || ')' AS shape, 'float' AS dtype, vec_id % 10 = 0 AS has_nan, CAST(list_min(embedding) AS DOUBLE) AS low, CAST(list_max(embedding) AS DOUBLE) AS high, false AS empty, 'cpu' AS device FROM embeddings")
def f5_f10_nested_arrays(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").withColumn("x", F.array("embedding", F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))))
    kind = e.schema["x"].dataType
    p = e.select("vec_id", profile.nested_array_profile(F.col("x"), kind).alias("p"), profile.tensor_profile(F.col("x"), kind, F.lit("cpu"), F.lit(False)).alias("tensor"))
    return p.select("vec_id", "p.*", "tensor.device")


@query("""WITH k AS (SELECT CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS kind, count(*) AS n FROM (DESCRIBE part) GROUP BY 1)
SELECT (SELECT count(*) FROM part) AS n_rows, CAST(sum(n) AS BIGINT) AS n_columns, (SELECT bool_or(p_partkey IS NULL OR p_name IS NULL OR p_brand IS NULL OR p_type IS NULL OR p_size IS NULL OR p_retailprice IS NULL) FROM part) AS has_nan, string_agg(kind || ':' || n, ',' ORDER BY kind) AS dtypes FROM k""")
def f6_table(spark, sf_dir):
    return profile.table_profile(t(spark, sf_dir, "part"))


@query("""WITH l AS (SELECT DISTINCT 'p_brand' AS column_name, p_brand v FROM part UNION SELECT DISTINCT 'p_type', p_type FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY v) k FROM l)
SELECT column_name, string_agg(CASE WHEN length(v) > 20 THEN v[:20] || '...' ELSE v END, '|' ORDER BY v) AS examples FROM r WHERE k <= 5 GROUP BY 1""")
def f7_examples(spark, sf_dir):
    return profile.examples(t(spark, sf_dir, "part"), ["p_brand", "p_type"]).withColumnRenamed("column", "column_name")


@query("""WITH e AS (SELECT event_id, event_type, event_id % 4 AS b FROM events)
SELECT event_id, CAST(CASE b WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS BIGINT) AS length, CASE b WHEN 0 THEN 'scalar_metrics_dict' WHEN 1 THEN 'training_history_dict' WHEN 2 THEN 'sklearn_dataset_dict' END AS detected,
CASE b WHEN 0 THEN 'k' WHEN 1 THEN 'loss,acc' WHEN 2 THEN 'data,target' ELSE 'name,on,list' END AS keys, CASE WHEN b = 1 THEN event_id % 3 + 1 END AS n_epochs,
CASE WHEN b = 2 THEN '(2, 3)' END AS data_shape, CASE WHEN b = 2 THEN '(2,)' END AS target_shape, CASE WHEN b = 3 THEN 'name=' || event_type || ';on=true;list=[1]' END AS preview, CASE WHEN b = 3 THEN 'str;bool;list' END AS value_types FROM e""")
def f8_map(spark, sf_dir):
    b, e = F.col("event_id") % 4, t(spark, sf_dir, "events")
    epochs = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("event_id") % 3 + 1).cast("int")), lambda x: x.cast("string")), ",")
    given = F.when(b == 0, F.col("props")).when(b == 1, F.format_string('{"loss": [%s], "acc": [%s]}', epochs, epochs)).when(b == 2, '{"data": [[1, 2, 3], [4, 5, 6]], "target": [0, 1]}').otherwise(F.format_string('{"name": "%s", "on": true, "list": [1]}', "event_type"))
    return e.select("event_id", profile.map_profile(F.from_json(given, "map<string,string>")).alias("p")).select("event_id", "p.*")


@query("WITH s AS (SELECT DISTINCT len(embedding) AS n FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 10)) SELECT 'embedding' AS field, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS sizes FROM s")
def f15_sampled_shapes(spark, sf_dir):
    return profile.sampled_shapes(t(spark, sf_dir, "embeddings"), ["embedding"], "vec_id")


# Subsets of all vectors by label, of them every second one from the end, of those the ones at odd places and, counted from the end, the last.
_SUBSETS = """base AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, label, embedding FROM embeddings),
one AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY place) - 1 AS pos, place FROM base),
one_n AS (SELECT label, count(*) AS n FROM one GROUP BY 1),
two AS (SELECT label, pos // 2 AS pos, n - 1 - pos AS at FROM one JOIN one_n USING (label) WHERE pos % 2 = 0),
two_n AS (SELECT label, count(*) AS n FROM two GROUP BY 1)"""


@query(f"""WITH {_SUBSETS},
three AS (SELECT label, pos // 2 AS pos, pos AS at FROM two WHERE pos % 2 = 1 UNION ALL SELECT label, n // 2, n - 1 FROM two_n),
d AS (SELECT 'base' AS dataset, place AS pos, place FROM base UNION ALL SELECT 'one' || label, pos, place FROM one
  UNION ALL SELECT 'two' || label, two.pos, one.place FROM two JOIN one USING (label) WHERE one.pos = two.at
  UNION ALL SELECT 'three' || label, three.pos, one.place FROM three JOIN two USING (label) JOIN one USING (label) WHERE two.pos = three.at AND one.pos = two.at),
s AS (SELECT dataset, pos, len(embedding) - vec_id % 2 AS size, label FROM d JOIN base USING (place) WHERE pos < 10),
f AS (SELECT dataset, 'input' AS field, '(' || size || ',)' AS shape FROM s UNION ALL SELECT dataset, 'label', 'int' FROM s)
SELECT dataset, field, string_agg(DISTINCT shape, ' ' ORDER BY shape) AS shapes, count(*) AS n, CASE WHEN count(DISTINCT shape) = 1 AND min(shape) LIKE '(%' THEN '(' || count(*) || ', ' || replace(substr(min(shape), 2), ',)', ')') END AS batch_shape FROM f GROUP BY dataset, field""")
def f15_subset_chains(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    label = F.col("label").cast("string")
    base = summary.positioned(e, [F.col("vec_id")], "place").withColumn("place", F.col("place") - 1)
    nth = lambda df, order: summary.positioned(df, [F.col(order)], "pos", ["label"]).withColumn("pos", F.col("pos") - 1)
    one = nth(base.select("label", "place"), "place")
    size = one.groupBy("label").agg(F.count("*").alias("n"))
    two = one.where("pos % 2 = 0").join(size, "label").select("label", F.floor(F.col("pos") / 2).alias("pos"), (F.col("n") - 1 - F.col("pos")).alias("index"))
    half = two.groupBy("label").agg(F.count("*").alias("n"))
    three = two.where("pos % 2 = 1").select("label", F.floor(F.col("pos") / 2).alias("pos"), F.col("pos").alias("index")).unionByName(half.select("label", F.floor(F.col("n") / 2).alias("pos"), F.lit(-1).cast("long").alias("index")))
    name = lambda stem: F.concat(F.lit(stem), label)
    levels = [("one", one.select("label", "pos", F.col("place").alias("index")), F.lit("base")), ("two", two, name("one")), ("three", three, name("two"))]
    known = e.agg(F.count("*").alias("length")).select(F.lit("base").alias("dataset"), F.lit(None).cast("string").alias("parent"), "length")
    indices = None
    for stem, rows, parent in levels:
        known = known.unionByName(rows.groupBy("label").agg(F.count("*").alias("length")).select(name(stem).alias("dataset"), parent.alias("parent"), "length"))
        more = rows.select(name(stem).alias("dataset"), "pos", "index")
        indices = more if indices is None else indices.unionByName(more)
    shape = F.concat(F.lit("("), (F.size("embedding") - F.col("vec_id") % 2).cast("string"), F.lit(",)"))
    samples = base.select(F.lit("base").alias("dataset"), "place", F.posexplode(F.array(shape, F.lit("int"))).alias("number", "shape")).select("dataset", "place", datasets.field_name(F.col("number")).alias("field"), "shape")
    return datasets.sample_shapes(datasets.sample_places(known, indices), samples).withColumn("shapes", F.array_join("shapes", " "))


@query("""WITH r AS (SELECT event_id AS id, event_id % 6 AS k, CAST(props AS JSON)->>'$.k' AS v FROM events),
f(k, kind, key, value) AS (VALUES (0, 'directory_iterator', 'n_samples', 'v'), (0, 'directory_iterator', 'num_classes', NULL), (0, 'directory_iterator', 'batch_size', '32'), (0, 'directory_iterator', 'image_shape', 'shape'), (0, 'directory_iterator', 'target_size', NULL),
(1, 'dataset', 'type', 'tensorflow.python.data.ops.MapDataset'), (1, 'dataset', 'element_spec', 'v'),
(2, 'frame_iterator', 'type', 'keras.src.image.DataFrameIterator'), (2, 'frame_iterator', 'n_samples', 'v'), (2, 'frame_iterator', 'samples', 'v'), (2, 'frame_iterator', 'batch_size', NULL), (2, 'frame_iterator', 'image_shape', NULL), (2, 'frame_iterator', 'class_mode', 'binary'), (2, 'frame_iterator', 'num_classes', '2'),
(3, 'loader', 'type', 'torch.utils.data.dataloader.DataLoader'), (3, 'loader', 'num_batches', 'v'), (3, 'loader', 'num_examples', 'v'), (3, 'loader', 'batch_size', '8'), (3, 'loader', 'dataset_type', NULL),
(4, 'estimator', 'class_name', 'Ridge'), (4, 'estimator', 'module', 'sklearn.linear_model'), (4, 'estimator', 'is_fitted', 'fitted'), (4, 'estimator', 'n_features_in_', 'features'), (4, 'estimator', 'n_outputs_', 'outputs'))
SELECT id, kind, key, CASE value WHEN 'v' THEN v WHEN 'shape' THEN '(' || v || ', 2)' WHEN 'fitted' THEN CASE WHEN id % 4 = 0 THEN 'true' ELSE 'false' END WHEN 'features' THEN v WHEN 'outputs' THEN NULL ELSE value END AS value
FROM r JOIN f USING (k) WHERE NOT (key IN ('n_features_in_', 'n_outputs_') AND id % 4 <> 0)""")
def f11_f17_recorded_metadata(spark, sf_dir):
    """Five kinds of records and one that is none, in one table."""
    k, v = F.col("event_id") % 6, F.get_json_object("props", "$.k")
    classes = F.element_at(F.array(*[F.struct(F.lit(m).alias("module"), F.lit(c).alias("class_name")) for m, c in (("keras.src.image", "DirectoryIterator"), ("tensorflow.python.data.ops", "MapDataset"), ("keras.src.image", "DataFrameIterator"), ("torch.utils.data.dataloader", "DataLoader"), ("sklearn.linear_model", "Ridge"), ("torch", "DataLoader"))]), (k + 1).cast("int"))
    given = (
        F.when(k == 0, F.format_string('{"n": %s, "batch_size": 32, "image_shape": [%s, 2], "target_size": null}', v, v)).when(k == 1, F.format_string('{"element_spec": "%s"}', v))
        .when(k == 2, F.format_string('{"n": %s, "samples": "%s", "class_mode": "binary", "class_indices": {"a": 0, "b": [1]}}', v, v)).when(k == 3, F.format_string('{"length": %s, "batch_size": 8, "dataset": {"length": %s}}', v, v))
        .when(F.col("event_id") % 4 == 0, F.format_string('{"alpha": 1, "coef_": [1], "n_features_in_": %s}', v)).otherwise('{"alpha": 1, "__private__": 2}')
    )
    rows = t(spark, sf_dir, "events").select(F.col("event_id").alias("name"), classes.alias("c"), given.alias("attributes")).select("name", "c.*", "attributes")
    return datasets.recorded_metadata(rows).withColumnRenamed("name", "id")


@query("SELECT count(DISTINCT p_type) AS n_classes, 'string' AS dtype FROM part")
def f16_classes(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return p.agg(F.count_distinct("p_type").alias("n_classes")).withColumn("dtype", F.lit(dict(p.dtypes)["p_type"]))


# -- diagnostics and grading -------------------------------------------------

def findings(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = t(spark, sf_dir, "events").select("event_id", "event_type", k.alias("k"))
    symbol = F.when(F.col("k") % 4 == 0, None).when(F.col("k") % 4 == 1, "import-error").otherwise("other-code")
    message = F.when(F.col("k") % 6 == 0, "Module 'cv2' has no 'imread' member").when(F.col("k") % 6 == 1, "say Module 'cv2' has no 'imread' member").when(F.col("k") % 6 == 2, "Expected expression here").otherwise("fine")
    return e.withColumn("symbol", symbol).withColumn("message", message)


_FINDINGS = """SELECT event_id, event_type, k, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'import-error' ELSE 'other-code' END AS symbol,
CASE k % 6 WHEN 0 THEN 'Module ''cv2'' has no ''imread'' member' WHEN 1 THEN 'say Module ''cv2'' has no ''imread'' member' WHEN 2 THEN 'Expected expression here' ELSE 'fine' END AS message
FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


@query(f"WITH f AS ({_FINDINGS}) SELECT event_id, symbol, message FROM f WHERE event_type = 'error' AND coalesce(symbol, '') NOT IN ('no-name-in-module', 'import-error', 'syntax-error') AND message <> 'Module ''cv2'' has no ''imread'' member'")
def p12_exact_filter(spark, sf_dir):
    f = findings(spark, sf_dir)
    return f.where(diagnostics.keeps_a(F.col("event_type"), F.col("symbol"), F.col("message"))).select("event_id", "symbol", "message")


@query(f"WITH f AS ({_FINDINGS}) SELECT event_id, symbol AS rule, message FROM f WHERE event_type = 'error' AND coalesce(symbol, '') <> 'import-error' AND NOT contains(message, 'Expected expression')")
def p13_substring_filter(spark, sf_dir):
    f = findings(spark, sf_dir).withColumnRenamed("symbol", "rule")
    return f.where(diagnostics.keeps_b(F.col("event_type"), F.col("rule"), F.col("message"), ["import-error"])).select("event_id", "rule", "message")


@query(f"""WITH f AS (SELECT event_id, event_type, message, CASE k % 5 WHEN 0 THEN 'reportMissingImports' WHEN 1 THEN 'reportPossiblyUnboundVariable' WHEN 2 THEN 'reportCallIssue' WHEN 3 THEN 'reportAssignmentType' END AS rule FROM ({_FINDINGS}))
SELECT event_id, rule, message FROM f WHERE event_type = 'error' AND coalesce(rule, '') NOT IN ('reportMissingImports', 'reportPossiblyUnboundVariable', 'reportAssignmentType') AND NOT contains(message, 'Expected expression')""")
def p13_default_rules(spark, sf_dir):
    k = F.col("k") % 5
    rule = F.when(k == 0, "reportMissingImports").when(k == 1, "reportPossiblyUnboundVariable").when(k == 2, "reportCallIssue").when(k == 3, "reportAssignmentType")
    f = findings(spark, sf_dir).withColumn("rule", rule)
    return f.where(diagnostics.keeps_b(F.col("event_type"), F.col("rule"), F.col("message"))).select("event_id", "rule", "message")


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, CAST(doc_id % 4 AS INT) AS n FROM documents)
SELECT doc_id, n || ': ' || coalesce(CASE WHEN n >= 1 THEN l[n] END, '') AS line_a, (n + 1) || ': ' || coalesce(l[n + 1], '') AS line_b FROM d""")
def p14_code_lines(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 4).cast("int").alias("n"))
    return d.select("doc_id", diagnostics.code_line_a(F.col("text"), F.col("n")).alias("line_a"), diagnostics.code_line_b(F.col("text"), F.col("n")).alias("line_b"))


@query("""WITH d AS (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN 'No cell has been executed' || chr(10) || text ELSE text END, chr(10)) AS l, CAST(doc_id % 2 * 50 AS INT) AS n FROM documents)
SELECT doc_id, n FROM d WHERE NOT coalesce(contains(l[n + 1], 'No cell has been executed'), false)""")
def p15_placeholder(spark, sf_dir):
    code = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("No cell has been executed\n"), "text")).otherwise(F.col("text"))
    d = t(spark, sf_dir, "documents").select("doc_id", code.alias("code"), (F.col("doc_id") % 2 * 50).cast("int").alias("n"))
    return diagnostics.without_placeholder(d, "code", "n").select("doc_id", "n")


_GRADE = "CASE WHEN d IS NULL THEN 'cannot verify' WHEN contains(i, 'fixed') THEN CASE WHEN d THEN 'wrong' ELSE 'correct' END WHEN contains(i, 'reproduced') THEN CASE WHEN d THEN 'check reasoning' ELSE 'wrong' END ELSE 'cannot verify' END"


def graded(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events")
    run = F.when(F.col("value") > 60, '{"detection": true}').when(F.col("value") > 20, '{"detection": 0, "reasoning": "x"}').when(F.col("value") > 10, '{"reasoning": "x"}').otherwise("[Error-skipping]")
    return e.select(F.concat(F.lit("u_"), F.col("user_id").cast("string"), F.lit("_"), F.when(F.col("user_id") % 2 == 0, "fixed").otherwise("reproduced")).alias("instance"), "event_id", run.alias("run"))


_GRADED = """SELECT 'u_' || user_id || '_' || CASE WHEN user_id % 2 = 0 THEN 'fixed' ELSE 'reproduced' END AS i, event_id, CASE WHEN value > 60 THEN true WHEN value > 20 THEN false END AS d FROM events"""


@query(f"WITH g AS ({_GRADED}), r AS (SELECT i, event_id, {_GRADE} AS grade FROM g), c AS (SELECT i, grade, count(*) n, min(event_id) lo FROM r GROUP BY ALL) SELECT i AS instance, grade AS vote, n AS n_votes FROM c QUALIFY row_number() OVER (PARTITION BY i ORDER BY n DESC, lo) = 1")
def g1_g5_grade_runs(spark, sf_dir):
    return grading.grade_runs(graded(spark, sf_dir), ["instance"], "run", "event_id", check_reasoning=True)


@query("""WITH f AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 90) AS n FROM events GROUP BY 1)
SELECT user_id, CASE WHEN user_id % 2 = 0 THEN CASE WHEN n > 0 THEN 'wrong' ELSE 'correct' END ELSE CASE WHEN n > 0 THEN 'correct' ELSE 'wrong' END END AS grade FROM f""")
def g2_grade_findings(spark, sf_dir):
    f = t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.when((F.col("event_type") == "error") & (F.col("value") > 90), F.col("event_id"))).alias("found"))
    status = F.when(F.col("user_id") % 2 == 0, "x_1_fixed").otherwise("x_1_reproduced")
    return f.select("user_id", grading.grade_findings(status, F.col("found")).alias("grade"))


@query(f"""WITH g AS ({_GRADED}), r AS (SELECT i, event_id, {_GRADE.replace("'check reasoning'", "'correct'")} AS grade FROM g), c AS (SELECT i, grade, count(*) n, min(event_id) lo FROM r GROUP BY ALL),
v AS (SELECT i, grade FROM c QUALIFY row_number() OVER (PARTITION BY i ORDER BY n DESC, lo) = 1), h AS (SELECT 'u_' || c_custkey || '_fixed' AS instance, c_mktsegment AS label FROM customer)
SELECT instance, coalesce(grade, label) AS label FROM h LEFT JOIN v ON i = instance""")
def g3_grade_and_scatter(spark, sf_dir):
    v = grading.grade_runs(graded(spark, sf_dir), ["instance"], "run", "event_id").select("instance", F.col("vote").alias("label"))
    h = t(spark, sf_dir, "customer").select(F.concat(F.lit("u_"), F.col("c_custkey").cast("string"), F.lit("_fixed")).alias("instance"), F.col("c_mktsegment").alias("label"))
    return summary.scattered(h, v, "instance", "label")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'cannot verify' WHEN (p_partkey % 2 = 0) <> (p_size % 2 = 0) THEN 'wrong' WHEN p_partkey % 2 <> 0 THEN 'correct' WHEN p_size % 5 >= 3 THEN 'correct' WHEN p_size % 5 > 0 THEN 'partially correct' ELSE 'reasoning wrong' END AS grade FROM part""")
def g4_rubric(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    truth = F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 2 == 0)
    return p.select("p_partkey", grading.rubric(truth, F.col("p_size") % 2 == 0, F.col("p_size") % 5, F.lit(3)).alias("grade"))


# -- sequences and texts -----------------------------------------------------

def cells(spark, sf_dir) -> DataFrame:
    """Users as notebooks: events in order are cells, errors fail; every 17th cell asks to be run again, some have no count."""
    from pyspark.sql import Window

    e = t(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    c = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("notebook"), (n - 1).cast("int").alias("code_cell_id"), "event_id", "event_type")
    count = F.when(F.col("event_id") % 13 != 0, (F.col("code_cell_id") * 7 % 50).cast("int"))
    code = F.concat(F.when(F.col("event_id") % 17 == 0, "# [reexecute]\n").otherwise(""), F.col("event_type"), F.lit(" = "), F.col("event_id").cast("string"))
    return c.select("notebook", "code_cell_id", count.alias("execution_count"), code.alias("code"), (F.col("event_type") == "error").alias("has_error"))


_CELLS = """SELECT 'u' || user_id AS notebook, CAST(k AS INT) AS code_cell_id, CASE WHEN event_id % 13 <> 0 THEN CAST(k * 7 % 50 AS INT) END AS execution_count, CASE WHEN event_id % 17 = 0 THEN '# [reexecute]' || chr(10) ELSE '' END || event_type || ' = ' || event_id AS code, event_type = 'error' AS has_error
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)"""
_SPLIT = f"""c AS ({_CELLS}), tg AS (SELECT notebook, min(code_cell_id) FILTER (has_error) AS target FROM c GROUP BY 1), tc AS (SELECT notebook, min(execution_count) AS target_count FROM c JOIN tg USING (notebook) WHERE code_cell_id = target GROUP BY 1),
s AS (SELECT c.*, coalesce(code_cell_id = target, false) AS is_target, contains(split_part(code, chr(10), 1), '[reexecute]') OR (NOT coalesce(code_cell_id = target, false) AND coalesce(execution_count < target_count, false)) AS is_executed FROM c LEFT JOIN tg USING (notebook) LEFT JOIN tc USING (notebook))"""


@query(f"WITH c AS ({_CELLS}) SELECT notebook, min(code_cell_id) FILTER (has_error) AS target FROM c GROUP BY 1")
def q1_first_failing(spark, sf_dir):
    return sequence.first_failing(cells(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, text, doc_id % 4 AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1 THEN trim(string_split(text, chr(10))[n]) END AS crash_line FROM d""")
def q2_crash_line(spark, sf_dir):
    trace = F.format_string("\x1b[0;31mError\x1b[0m\n<ipython-input-12-ab3> in <cell line: %d>()", F.col("doc_id") % 4)
    d = t(spark, sf_dir, "documents").select("doc_id", trace.alias("traceback"), "text")
    return sequence.with_crash_lines(d, "traceback", "text").select("doc_id", "crash_line")


@query(f"WITH {_SPLIT} SELECT * FROM s")
def q3_split_cells(spark, sf_dir):
    return sequence.split_cells(cells(spark, sf_dir))


@query(f"""WITH c AS ({_CELLS}), tw AS (SELECT replace(notebook, 'u', 'v') AS notebook, min(code_cell_id) FILTER (has_error) AS target FROM c GROUP BY 1), f AS (SELECT replace(notebook, 'u', 'v') AS notebook, code_cell_id, execution_count + 1 AS execution_count, code, false AS has_error FROM c),
tc AS (SELECT notebook, min(execution_count) AS target_count FROM f JOIN tw USING (notebook) WHERE code_cell_id = target GROUP BY 1)
SELECT f.*, coalesce(code_cell_id = target, false) AS is_target, contains(split_part(code, chr(10), 1), '[reexecute]') OR (NOT coalesce(code_cell_id = target, false) AND coalesce(execution_count < target_count, false)) AS is_executed FROM f LEFT JOIN tw USING (notebook) LEFT JOIN tc USING (notebook)""")
def q4_split_fixed_twin(spark, sf_dir):
    c = cells(spark, sf_dir)
    twin = F.replace("notebook", F.lit("u"), F.lit("v"))
    targets = sequence.twin_targets(c, twin).withColumnRenamed("base", "notebook")
    fixed = c.select(twin.alias("notebook"), "code_cell_id", (F.col("execution_count") + 1).alias("execution_count"), "code", F.lit(False).alias("has_error"))
    return sequence.split_cells(fixed, targets)


def turns(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    c = t(spark, sf_dir, "conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    return c.select(F.col("conv_id").alias("notebook"), F.col("turn").cast("int").alias("code_cell_id"), F.col("turn").cast("int").alias("execution_count"), F.col("text").alias("code"), (F.col("turn") == last).alias("is_target"), (F.col("turn") < last).alias("is_executed"))


@query("""WITH c AS (SELECT conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id AS notebook, '# Executed Cells:' || chr(10) || coalesce(string_agg('## Cell ' || k || ':' || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) FILTER (turn < m), 'No cell has been executed' || chr(10)) || '# Target Cell:' || chr(10) || max(text) FILTER (turn = m) AS text FROM c GROUP BY 1""")
def q5_o6_t18_prompts(spark, sf_dir):
    return sequence.prompts(turns(spark, sf_dir), comments=True)


def documents_with_markers(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id") % 4
    text = F.concat(F.lit("head\n"), F.when(k != 0, X.RUNTIME).otherwise(""), F.coalesce("text", F.lit("")), F.when(k != 1, F.lit("\n" + X.TARGET)).otherwise(""), F.lit("tail"))
    return t(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


_MARKED = """SELECT doc_id, 'head' || chr(10) || CASE WHEN doc_id % 4 <> 0 THEN '# Current relevent runtime information:' || chr(10) ELSE '' END || coalesce(text, '') || CASE WHEN doc_id % 4 <> 1 THEN chr(10) || '# Target Cell:' || chr(10) ELSE '' END || 'tail' AS text FROM documents"""


@query(f"""WITH m AS ({_MARKED}), p AS (SELECT *, strpos(text, '# Current relevent runtime information:' || chr(10)) AS a, strpos(text, '# Target Cell:' || chr(10)) AS b FROM m)
SELECT doc_id, substr(text, a, CASE WHEN b > 0 THEN b ELSE length(text) + 1 END - a) AS section FROM p WHERE a > 0""")
def q6_t10_sections(spark, sf_dir):
    m = documents_with_markers(spark, sf_dir)
    return m.select("doc_id", X.between(F.col("text"), X.RUNTIME, X.TARGET).alias("section")).where("section IS NOT NULL")


@query("""SELECT item_id, 'Ground truth:' || chr(10) || text || chr(10) || chr(10) || 'Prediction:' || chr(10) || lower(text) AS straight, 'Prediction:' || chr(10) || lower(text) || chr(10) || chr(10) || 'Ground truth:' || chr(10) || text AS reversed_order FROM benchmark""")
def q7_grader_messages(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark")
    return b.select("item_id", sequence.grader_message(F.col("text"), F.lower("text")).alias("straight"), sequence.grader_message(F.col("text"), F.lower("text"), True).alias("reversed_order"))


@query(f"""WITH c AS ({_CELLS}), d AS (SELECT notebook, split_part(split_part(code, chr(10), CASE WHEN contains(code, chr(10)) THEN 2 ELSE 1 END), ' = ', 1) AS name, execution_count AS cellno, CAST(CASE WHEN contains(code, chr(10)) THEN 2 ELSE 1 END AS INT) AS lineno, code_cell_id FROM c WHERE execution_count IS NOT NULL)
SELECT notebook, name, cellno, lineno FROM d QUALIFY row_number() OVER (PARTITION BY notebook, name ORDER BY cellno DESC, code_cell_id DESC, lineno DESC) = 1""")
def q8_last_definitions(spark, sf_dir):
    return sequence.last_definitions(cells(spark, sf_dir).where("execution_count IS NOT NULL"))


@query("""SELECT p_partkey AS notebook, unnest(['print', 'x' || p_size, 'z']) AS name, NULL AS attr FROM part UNION ALL SELECT p_partkey, 'x' || p_size, 'shape' FROM part UNION ALL SELECT p_partkey, 'z', '[]' FROM part""")
def q9_dependencies(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("notebook"), F.format_string("y = 1\ndef f():\n    return hidden[0]\nprint(x%d.shape, z[1])", "p_size").alias("code"))
    return sequence.target_dependencies(p)


@query("SELECT p_partkey AS notebook, 'x' || p_size AS name FROM part WHERE p_size % 2 = 0")
def q10_present(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    needed = p.select(F.col("p_partkey").alias("notebook"), F.format_string("x%d", "p_size").alias("name"))
    return sequence.present(needed, p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("notebook"), F.format_string("x%d", "p_size").alias("name")))


@query("SELECT page_id, lower(trim(url)) AS t1, split_part(url, '/', 3) AS host, starts_with(url, 'http') AS s, ends_with(url, '/') AS e, contains(url, 'www') AS c, regexp_extract(url, '^(\\w+)://', 1) AS scheme, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, CAST(len(regexp_extract_all(html, '<p')) AS BIGINT) AS paragraphs FROM pages")
def t1_t6_text_functions(spark, sf_dir):
    p, u = t(spark, sf_dir, "pages"), F.col("url")
    return p.select(
        "page_id", F.lower(F.trim(u)).alias("t1"), F.coalesce(F.try_element_at(F.split(u, "/"), F.lit(3)), F.lit("")).alias("host"), F.startswith(u, F.lit("http")).alias("s"), F.endswith(u, F.lit("/")).alias("e"),
        u.contains("www").alias("c"), F.regexp_extract(u, "^(\\w+)://", 1).alias("scheme"), F.regexp_replace(u, "[0-9]+", "#").alias("masked"), F.regexp_count("html", F.lit("<p")).cast("long").alias("paragraphs"),
    )


@query("""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<(h[1-6])[^>]*>([^<]*)</h[1-6]>', 1)) AS tag, unnest(regexp_extract_all(html, '<(h[1-6])[^>]*>([^<]*)</h[1-6]>', 2)) AS title FROM pages) SELECT page_id, tag, title, count(*) AS n FROM m GROUP BY ALL""")
def t7_find_all(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", F.explode(X.pairs_of(F.col("html"), "<(h[1-6])[^>]*>([^<]*)</h[1-6]>")).alias("x"))
    return p.groupBy("page_id", F.col("x.first").alias("tag"), F.col("x.second").alias("title")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type || ' plain' AS text FROM events")
def t8_ansi(spark, sf_dir):
    coloured = F.concat(F.lit("\x1b[1;31m"), "event_type", F.lit("\x1b[0m plain\x1b[K"))
    return t(spark, sf_dir, "events").select("event_id", X.without_ansi(coloured).alias("text"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, string_split(text, chr(10))[2] AS second FROM documents")
def t9_lines(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(X.lines_of(F.col("text"))).cast("long").alias("n_lines"), X.line_at(F.col("text"), F.lit(2)).alias("second"))


@query("SELECT event_id, CASE WHEN value > 20 THEN value > 60 END AS detection, CASE WHEN value <= 20 THEN 'raw ' || event_id END AS raw FROM events")
def t11_json_or_raw(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    text = F.when(F.col("value") > 20, F.format_string('{"reasoning": "r", "detection": %s}', (F.col("value") > 60).cast("string"))).otherwise(F.concat(F.lit("raw "), F.col("event_id").cast("string")))
    return e.select("event_id", X.json_or_raw(text, "reasoning string, detection boolean").alias("x")).select("event_id", "x.parsed.detection", "x.raw")


@query("SELECT p_partkey, 'x' || p_size AS name, 'pandas.' || p_brand AS type FROM part")
def t12_literals(spark, sf_dir):
    from verdigris.functions.code import typed_names

    p = t(spark, sf_dir, "part").select("p_partkey", F.format_string("{'x%d': {'type': 'pandas.%s', 'shape': (1, 2)}}", "p_size", "p_brand").alias("info"))
    return p.select("p_partkey", F.explode(typed_names(F.col("info"))).alias("x")).select("p_partkey", "x.*")


@query("""SELECT p_partkey, unnest(['a', 'x' || p_size, 'm']) AS name, unnest(['int', 'pandas.' || p_brand, '<class ''q.Z''>']) AS type FROM part""")
def t12_fallback(spark, sf_dir):
    from verdigris.functions.code import typed_names

    info = F.format_string("{'a': {'type': 'int', 'v': <x.Y object at 0x1f>}, 'x%d': {'type': 'pandas.%s', 'shape': (1, 2}, '__method__f': {'type': 'int'}, 'm': {'type': \"<class 'q.Z'>\"}, broken", "p_size", "p_brand")
    p = t(spark, sf_dir, "part").select("p_partkey", F.explode(typed_names(info)).alias("x"))
    return p.select("p_partkey", "x.*")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand END AS cleaned FROM part")
def t13_clean_type(spark, sf_dir):
    p, k = t(spark, sf_dir, "part"), F.col("p_size") % 4
    raw = F.when(k == 0, F.format_string(" <class '%s'> ", "p_brand")).when(k == 1, F.col("p_brand")).when(k == 2, "<class '<lambda>'>").otherwise("")
    return p.select("p_partkey", X.clean_type(raw).alias("cleaned"))


@query("SELECT p_partkey, 'shape=(None, ' || p_size || '), dtype=tf.float32' AS spec FROM part")
def t14_spec(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", X.spec_text(F.format_string("TensorSpec(shape=(None, %d), dtype=tf.float32, name=None)", "p_size")).alias("spec"))


@query("SELECT p_partkey, 'numpy:np,os:os,torch.nn:torch.nn,torch:torch,x' || p_size || '.y:z,x' || p_size || ':x' || p_size AS imports FROM part")
def t15_imports(spark, sf_dir):
    code = F.format_string("import numpy as np\nimport torch.nn\nimport os\nfrom a import b\n import x%d.y as z\nimport numpy", "p_size")
    found = X.import_aliases(code)
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(F.transform(found, lambda m: F.concat(m["module"], F.lit(":"), m["alias"]))), ",").alias("imports"))


@query("SELECT event_id, event_type || ' = ''# no''' || chr(10) || 'y = 2' AS code FROM events")
def t16_comments(spark, sf_dir):
    from verdigris.functions.code import without_comments

    code = F.concat("event_type", F.lit(" = '# no'  # note\ny = 2"))
    return t(spark, sf_dir, "events").select("event_id", without_comments(code).alias("code"))


@query("SELECT p_partkey, 'f' || p_size AS name, 'def f' || p_size || '():' || chr(10) || '    return 1' AS source FROM part")
def t17_function_sources(spark, sf_dir):
    from verdigris.functions.code import function_sources

    code = F.format_string("x = 1\ndef f%d():\n    return 1  # one\n", "p_size")
    return t(spark, sf_dir, "part").select("p_partkey", F.explode(function_sources(code)).alias("x")).select("p_partkey", "x.*")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size / 1000 WHEN 1 THEN CAST(p_size AS DOUBLE) ELSE p_size * 60.0 END AS seconds FROM part")
def t19_retry_seconds(spark, sf_dir):
    p, k = t(spark, sf_dir, "part"), F.col("p_size") % 3
    said = F.format_string("try again in %d%s.", "p_size", F.when(k == 0, "ms").when(k == 1, "s").otherwise("m"))
    return p.select("p_partkey", X.retry_seconds(said).alias("seconds"))


# -- aliases ---------------------------------------------------------------

@query("SELECT 'geo' AS package, 'geo.' || n_name AS internal, 'p' AS public FROM nation WHERE n_nationkey % 2 = 0")
def m4_cleanup(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    return aliases.cleaned_map(n.select(F.lit("geo").alias("package"), F.concat(F.when(F.col("n_nationkey") % 2 == 0, "geo.").otherwise("geography."), "n_name").alias("internal"), F.lit("p").alias("public")))


@query("SELECT 'geo' AS package, 'r' || n_regionkey AS internal, arg_max(n_name, n_nationkey) AS public FROM nation GROUP BY n_regionkey")
def m2_last_public(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select(F.lit("geo").alias("package"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("internal"), F.col("n_name").alias("public"), "n_nationkey")
    return aliases.last_public(n, "n_nationkey")


@query("""SELECT 'p_' || p_partkey AS instance, 'import scipy' || chr(10) || chr(10) || 'a: np.ndarray' || chr(10) || 'b: int' || chr(10) || 'c: scipy.T' || p_size || chr(10) || chr(10) || 'print(a)' AS text FROM part""")
def m6_annotated(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    instance = F.format_string("p_%d", "p_partkey")
    codes = p.select(instance.alias("instance"), F.lit("print(a)").alias("code"), F.lit("import numpy as np").alias("executed"))
    variable = lambda n, kind, at: F.struct(F.lit(n).alias("name"), kind.alias("type"), F.lit(at).alias("ord"))
    given = F.array(variable("a", F.lit("<class 'numpy.core.ndarray'>"), 1), variable("b", F.lit("builtins.int"), 2), variable("c", F.format_string("scipy.T%d", "p_size"), 3), variable("m", F.lit("module"), 4), variable("__method__x", F.lit("int"), 5))
    rows = p.select(instance.alias("instance"), F.explode(given).alias("v")).select("instance", "v.*")
    names = spark.createDataFrame([("numpy", "numpy.core.ndarray", "numpy.ndarray")], "package string, internal string, public string")
    return aliases.annotated(codes, rows, names)


# Modules: regions hold their nations, nations lead to two others and back to their region, both hold objects of which several go by one internal path.
_MEMBERS = """
nations AS (SELECT n.*, r_name FROM nation n JOIN region ON n_regionkey = r_regionkey),
links AS (SELECT r_name AS module, 'n' || n_nationkey AS attr, n_name AS target FROM nations
  UNION SELECT a.n_name, 'a' || b.n_nationkey, b.n_name FROM nation a JOIN nation b ON b.n_nationkey IN ((a.n_nationkey * 7 + 3) % 25, (a.n_nationkey * 3 + 11) % 25)
  UNION SELECT n_name, 'up', r_name FROM nations),
own AS (SELECT n_name AS module, c_name AS attr, 'home' || c_nationkey % 4 || '.Q' || c_custkey % 50 AS internal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0
  UNION ALL SELECT r_name, s_name, 'home' || s_nationkey % 4 || '.Q' || s_suppkey % 50 FROM supplier JOIN nations ON s_nationkey = n_nationkey)"""


def members(spark, sf_dir) -> DataFrame:
    nation, region = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")
    key = lambda c: F.col(c).cast("string")
    module = lambda m, attr, target: [m.alias("module"), attr.alias("attr"), F.lit("module").alias("kind"), target.alias("target"), none.alias("home"), none.alias("qualname"), none.alias("name")]
    thing = lambda m, attr, at, qualname: [m.alias("module"), attr.alias("attr"), F.lit("type").alias("kind"), none.alias("target"), F.concat(F.lit("home"), (F.col(at) % 4).cast("string")).alias("home"), qualname.alias("qualname"), none.alias("name")]
    q = lambda c: F.concat(F.lit("Q"), (F.col(c) % 50).cast("string"))
    further = nation.select(F.col("n_name").alias("from"), F.explode(F.array((F.col("n_nationkey") * 7 + 3) % 25, (F.col("n_nationkey") * 3 + 11) % 25)).alias("to")).join(nation, F.col("to") == F.col("n_nationkey"))
    tables = [
        nations.select(module(F.col("r_name"), F.concat(F.lit("n"), key("n_nationkey")), F.col("n_name"))), further.select(module(F.col("from"), F.concat(F.lit("a"), key("n_nationkey")), F.col("n_name"))),
        nations.select(module(F.col("n_name"), F.lit("up"), F.col("r_name"))), nations.select(module(F.col("n_name"), F.lit("_hidden"), F.lit("HIDDEN"))),
        t(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(thing(F.col("n_name"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise(F.concat(F.lit("_"), "c_name")), "c_nationkey", q("c_custkey"))),
        t(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(thing(F.col("r_name"), F.col("s_name"), "s_nationkey", q("s_suppkey"))),
    ]
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


@query(f"""WITH RECURSIVE {_MEMBERS.strip()},
adj AS (SELECT module, list(struct_pack(attr := attr, target := target) ORDER BY attr) AS outs FROM links GROUP BY module),
walk(package, stack, pos, met, place, pushed) AS (
  SELECT r_name, [r_name], [1], CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), true FROM region
  UNION ALL
  SELECT package, CASE WHEN pops THEN stack[:len(stack) - 1] WHEN known THEN stack ELSE list_append(stack, step.target) END,
    CASE WHEN pops THEN pos[:len(pos) - 1] WHEN known THEN list_append(pos[:len(pos) - 1], pos[-1] + 1) ELSE list_append(list_append(pos[:len(pos) - 1], pos[-1] + 1), 1) END,
    CASE WHEN pops OR known THEN met ELSE list_append(met, step.target) END, CASE WHEN pops THEN place[:len(place) - 1] WHEN known THEN place ELSE list_append(place, step.attr) END, NOT (pops OR known)
  FROM (SELECT *, step IS NULL AS pops, coalesce(list_contains(met, step.target), false) AS known FROM (SELECT w.*, outs[pos[-1]] AS step FROM walk w LEFT JOIN adj ON module = stack[-1] WHERE len(stack) > 0))),
visits AS (SELECT package, stack[-1] AS module, place FROM walk WHERE pushed)
SELECT package, internal, arg_max(module || '.' || attr, list_append(place, attr)) AS public FROM visits JOIN own USING (module) GROUP BY package, internal""")
def m2_public_walk(spark, sf_dir):
    return publicnames.walked_names(members(spark, sf_dir), t(spark, sf_dir, "region").select(F.col("r_name").alias("package")))


def _rules_sql() -> str:
    text = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("$", "\\") + "'" if "$" in x and "^" not in x else f"'{x}'"
    return ", ".join("(" + ", ".join(text(x) for x in rule) + ")" for rule in publicnames.standard_rules())


_LISTS = {p: [*modules, f"{p}.private.deep", f"{p}.unlisted"] for p, modules in sorted(publicnames.LISTED.items())}
_ENDS = ["Functional", "Sequential", "image.DirectoryIterator", "PrefetchDataset", "Plain"]
_MODULE_SQL = "CASE p_partkey % 4 " + " ".join(f"WHEN {k} THEN {modules}[(p_partkey // 4) % {len(modules)} + 1]" for k, modules in enumerate(_LISTS.values())) + " END"


@query(f"""WITH rules(package, precedence, place, prefix, pattern, rewrite, by_name) AS (VALUES {_rules_sql()}),
m AS (SELECT {_MODULE_SQL} AS module, CASE WHEN p_size % 9 = 0 THEN '_' ELSE '' END || 'A' || p_size AS attr, CASE WHEN p_partkey % 11 = 0 THEN 'tensorflow.python.data.ops' ELSE {list(_LISTS)}[p_partkey % 4 + 1] || '.src' END AS home,
  {_ENDS}[p_partkey % 5 + 1] || CASE WHEN p_partkey % 5 = 4 THEN CAST(p_partkey % 61 AS VARCHAR) ELSE '' END AS called, p_partkey % 7 = 0 AS unqualified FROM part),
o AS (SELECT *, home || '.' || called AS internal FROM m WHERE NOT starts_with(attr, '_')),
met AS (SELECT *, CASE place WHEN 'public' THEN module || '.' || attr ELSE internal END AS path FROM o, rules WHERE by_name OR NOT unqualified),
hit AS (SELECT * FROM met WHERE (path = prefix OR starts_with(path, prefix || '.')) AND regexp_matches(path, pattern))
SELECT package, internal, public FROM (SELECT package, internal, arg_max(struct_pack(p := CASE WHEN rewrite IS NOT NULL THEN regexp_replace(path, pattern, rewrite) END), [lpad(CAST(precedence AS VARCHAR), 3, '0'), attr, module]).p AS public FROM hit GROUP BY ALL) WHERE public IS NOT NULL""")
def m3_ruled_names(spark, sf_dir):
    key, part = F.col("p_partkey"), t(spark, sf_dir, "part")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    module = F.coalesce(*[F.when(key % 4 == k, pick(modules, F.floor(key / 4))) for k, modules in enumerate(_LISTS.values())])
    called = F.concat(pick(_ENDS, key), F.when(key % 5 == 4, (key % 61).cast("string")).otherwise(""))
    home = F.when(key % 11 == 0, "tensorflow.python.data.ops").otherwise(F.concat(pick(list(_LISTS), key), F.lit(".src")))
    attr = F.concat(F.when(F.col("p_size") % 9 == 0, "_").otherwise(""), F.lit("A"), F.col("p_size").cast("string"))
    rows = part.select(module.alias("module"), attr.alias("attr"), F.lit("type").alias("kind"), F.lit(None).cast("string").alias("target"), home.alias("home"), F.when(key % 7 != 0, called).alias("qualname"), called.alias("name"))
    return publicnames.ruled_names(rows, spark.createDataFrame(publicnames.standard_rules(), publicnames.RULE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
