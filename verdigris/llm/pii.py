"""Personal data by bootstrapped contextual extraction. DataFrame functions only.

Base spans come from four patterns. They are the seeds of a bootstrap, and so
are secrets that show themselves (SECRET: long runs that change between letters
and digits), which however count as found only where a context confirms them:

1. Each base span, whole and with its blanks, and each blank-free token outside
   them that holds a digit or one of @ _ / \\ is an instance. Each occurrence
   induces five lexical patterns, each with the instance's shape: the word
   before, two words before, the word after, two after, and one on either side
   (shape: the kinds of characters that occur, and the length's power of two).
2. Instances and patterns make a bipartite graph of distinct edges; patterns of
   under MIN_SUPPORT instances can't be confident and are left out. A seed
   scores 1, others start at 0. In each round a pattern's confidence is the sum
   of its instances' scores over their number plus one; then an instance that
   is no seed scores the highest confidence of its patterns. Scores only grow,
   and the rounds end when no further instance gets to CONFIDENT.
3. Occurrences of instances in a pattern of at least CONFIDENT, and of all other
   instances that score so, are spans of kind `context` where they lie outside
   base spans. Base spans stay.

Matches have no positions in Spark, so the text between them is measured: the
i-th match starts after the first i + 1 gaps and the first i matches. Patterns
are written with possessive parts and look-behinds so that each character is
tried a bounded number of times, whatever the length of a word or number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import by_key, drop_written, joined_apart, written

KINDS = ["email", "ip", "card", "phone", "context"]
_LOCAL, _HOST, _PART = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]", "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Only the start of a run can begin a match, or the place where the last match ended.
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\\.{_HOST}++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "(?<![0-9])[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "context": "(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D0-9@_/\\\\]*+[0-9@_/\\\\][^\\x20\\x09-\\x0D]*+",
}
#: A text in which this is not found has no match: a plain character, or a short pattern.
_NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9](?:[\\x20-]?[0-9]){13}", "phone": "+", "context": "[0-9@_/\\\\]"}
#: At least 20 letters, digits, hyphens or underscores that change from digits to others four times.
SECRET = "^(?=(?:[A-Za-z_-]*+[0-9]++[A-Za-z_-]++){4})[A-Za-z0-9_-]{20,}$"
MIN_SUPPORT, CONFIDENT = 5, 0.9
#: Copies of the found instances, so that the places of a frequent one do not meet in one task.
SALTS = 16


def _luhn(digits: Column) -> Column:
    backwards = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(backwards, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == 1, hit.rlike(f"^{_PART}\\.{_PART}\\.{_PART}\\.{_PART}$"))
        .when(kind == 2, F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False))
        .when(kind == 3, (n >= 10) & (n <= 15))
        .otherwise(True)
    )


def _matches(text: Column, kind: int) -> Column:
    """An array of (kind, i, gap, hit, before, after) for the matches of one kind: gap is the length of the text since the last match, before and after are the two words beside."""
    pattern = PATTERNS[KINDS[kind]]
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    shifted = lambda a, n: F.slice(a, F.lit(1 + n), F.size(a)) if n > 0 else F.concat(F.array(F.lit("")), a)
    zip_of = lambda gaps, hits: F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), shifted(gaps, 1).alias("gap1"), shifted(gaps, 2).alias("gap2"), shifted(hits, 1).alias("hit1"), shifted(gaps, -1).alias("gap0"), shifted(hits, -1).alias("hit0"))
    words = lambda parts, n: F.lower(F.substring_index(F.trim(F.translate(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), "\n\t\r\x0b\f", "     ")), " ", n))
    # the text around a match, matches beside it included
    before = lambda x: words([x["gap0"], x["hit0"], x["gap"]], -2)
    after = lambda x: words([x["gap1"], x["hit1"], x["gap2"]], 2)
    found = lambda zipped: F.transform(zipped, lambda x, i: F.when(x["hit"].isNotNull(), F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["hit"].alias("hit"), before(x).alias("before"), after(x).alias("after"))))
    needs = _NEEDS[KINDS[kind]]
    tried = text.contains(needs) if len(needs) == 1 else text.rlike(needs)
    # Bound as a lambda's variable, as Spark would else split and search the text anew for each use.
    once = F.transform(F.array(F.struct(gaps.alias("gaps"), hits.alias("hits"))), lambda t: found(zip_of(t["gaps"], t["hits"])))
    return F.when(tried, F.filter(once[0], lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,hit:string,before:string,after:string>>"))


def _shape(token: Column) -> Column:
    """The kinds of characters in it and the power of two of its length."""
    kinds = {"a": "\\p{L}", "9": "[0-9]", "@": "@", ".": "\\.", "-": "-", "_": "_", "/": "[/\\\\]", " ": "[\\x20\\x09-\\x0D]", "o": "[^\\p{L}0-9@._/\\\\\\x20\\x09-\\x0D-]"}
    return F.concat(*[F.when(token.rlike(p), k).otherwise("") for k, p in kinds.items()], F.lit("/"), F.floor(F.log2(F.greatest(F.length(token), F.lit(1)))).cast("string"))


def _patterns(before: Column, instance: Column, after: Column) -> Column:
    """The five patterns of an occurrence, hashed with their kind. before, after: two words each."""
    shape, left, right = _shape(instance), F.substring_index(before, " ", -1), F.substring_index(after, " ", 1)
    one = lambda kind, *words: F.xxhash64(F.lit(kind), shape, *words)
    return F.array(one(0, left), one(1, before), one(2, right), one(3, after), one(4, left, right))


def _bootstrap(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instances and patterns, with their scores, that get to CONFIDENT; instances that are seeds are left out. edges: pattern, instance (distinct, read several times); seeds: instance (distinct).

    Seeds always score 1, so each pattern keeps their number and only the edges
    of other instances take part in the rounds. A pattern that a large part of
    all instances has, and an instance in a large part of all patterns, are
    joined by broadcast (joined_apart), so none of them is one task's work.
    """
    enough = written(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SUPPORT), "enough")
    kept = written(joined_apart(edges.select("pattern", "instance"), enough, ["pattern"], "n", edges.count()).where("n IS NOT NULL").drop("n"), "kept")
    total = kept.count()
    degrees = kept.groupBy("instance").agg(F.count("*").alias("d")).join(by_key(seeds.select("instance", F.lit(True).alias("seed"))), "instance", "left")
    degrees = written(degrees.withColumn("seed", F.coalesce("seed", F.lit(False))), "degrees")
    marked = written(joined_apart(kept, degrees, ["instance"], "d", total), "marked")
    others = marked.where("NOT seed").select("pattern", "instance", "d")
    seeded = written(enough.join(by_key(marked.where("seed").groupBy("pattern").agg(F.count("*").alias("s"))), "pattern", "left").select("pattern", "n", F.coalesce("s", F.lit(0)).alias("s")), "seeded")
    drop_written(enough, kept)
    sums, found, n_seeds, used = None, 0, degrees.where("seed").count(), [marked, seeded]
    drop_written(degrees)
    while True:
        all_scores = F.col("s") if sums is None else F.col("s") + F.coalesce("others", F.lit(0.0))
        patterns = (seeded if sums is None else seeded.join(by_key(sums), "pattern", "left")).select("pattern", "n", (all_scores / (F.col("n") + 1)).alias("confidence"))
        patterns = written(patterns.where("confidence > 0"), "patterns")
        scored = joined_apart(others, patterns, ["pattern"], "n", total).where("confidence IS NOT NULL").groupBy("instance", "d").agg(F.max("confidence").alias("score"))
        scores = written(scored, "scores")
        before, found = found, n_seeds + scores.where(F.col("score") >= CONFIDENT).count()
        if found == before:
            drop_written(*used)
            return scores.where(F.col("score") >= CONFIDENT).select("instance", "score"), patterns.where(F.col("confidence") >= CONFIDENT)
        sums = joined_apart(others.select("pattern", "instance"), scores, ["instance"], "d", total).where("score IS NOT NULL").groupBy("pattern").agg(F.sum("score").alias("others"))
        sums = written(sums, "sums")
        drop_written(patterns, scores)
        used.append(sums)


def _salted(df: DataFrame) -> DataFrame:
    return by_key(df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))


KEY = ["doc_id", "th"]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


def _places(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The base spans (doc_id, th, span) and the places of all instances (doc_id, th, kind, start, end, instance as its hash, seed, patterns)."""
    found = source.select(*KEY, F.explode(F.concat(*[_matches(F.col("text"), k) for k in range(len(KINDS))])).alias("x")).select(*KEY, "x.*")
    hits = written(found.dropDuplicates([*KEY, "kind", "i"]), "hits")
    run = Window.partitionBy(*KEY, "kind").orderBy("i")
    start = F.sum("gap").over(run.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum(F.length("hit")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = written(hits.withColumn("start", start).withColumn("end", F.col("start") + F.length("hit")).where(_holds(F.col("kind"), F.col("hit"))).drop("gap", "i"), "placed")
    drop_written(hits)
    base = placed.where("kind < 4").select(*KEY, F.struct("start", "kind", "end").alias("span"))
    covered = base.groupBy(*KEY).agg(F.collect_list("span").alias("base"))

    # Instances: the base spans, and the tokens that no base span touches.
    skin = "[^\\p{L}\\p{N}+]"
    tokens = placed.where("kind = 4").withColumn("lead", F.length(F.regexp_extract("hit", f"^{skin}*+", 0))).withColumn("instance", F.regexp_replace(F.regexp_replace("hit", f"^{skin}*+", ""), f"{skin}++$", ""))
    same = [placed["doc_id"].eqNullSafe(F.col("c_id")), placed["th"] == F.col("c_th")]
    tokens = tokens.join(by_key(covered.select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), "base")), same, "left").drop("c_id", "c_th")
    tokens = tokens.withColumn("start", F.col("start") + F.col("lead")).withColumn("end", F.col("start") + F.length("instance"))
    tokens = tokens.where(~F.coalesce(F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"])), F.lit(False)))
    names = [*KEY, "kind", "start", "end", "instance", "before", "after"]
    both = tokens.select(*names).unionByName(placed.where("kind < 4").withColumn("instance", F.col("hit")).select(*names)).where("length(instance) > 0")
    seed = (F.col("kind") < 4) | F.col("instance").rlike(SECRET)
    return base, written(both.select(*names[:5], F.xxhash64("instance").alias("instance"), seed.alias("seed"), _patterns(F.col("before"), F.col("instance"), F.col("after")).alias("patterns")), "places")


def _edges(places: DataFrame) -> DataFrame:
    return written(places.select("instance", F.explode("patterns").alias("pattern")).distinct(), "all_edges")


def recovered(docs: DataFrame, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kind, n_held, n_found: of the distinct seeds of each kind (context: secrets) every one_in-th by hash is held out, so it seeds nothing; found are those that the others' contexts bring back. What is held out counts against a pattern until it is found, so a large part can't be."""
    _, places = _places(_source(docs, id_col, text_col))
    held = F.pmod("instance", F.lit(one_in)) == 0
    seeds = places.where("seed").select("instance", "kind").distinct()
    known, _ = _bootstrap(_edges(places), seeds.where(~held).select("instance").distinct())
    out = seeds.where(held).join(by_key(known.select("instance", F.lit(1).alias("found"))), "instance", "left")
    return out.groupBy(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("kind")).agg(F.count("*").alias("n_held"), F.count("found").alias("n_found"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans, n_context, n_spans for each row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind as in KINDS, comma-joined. A null text counts as empty: no spans, and
    the hash of the empty string. Rows with one id and text share a result,
    null ids too. Other columns of docs are left out.
    """
    source = _source(docs, id_col, text_col)
    base, places = _places(source)
    known, confident = _bootstrap(_edges(places), places.where("seed").select("instance").distinct())
    # Tokens that are known instances; a secret that is a seed needs a confident pattern at its own place.
    tokens = places.where("kind = 4").withColumn("salt", F.pmod(F.xxhash64(*KEY, "start"), F.lit(SALTS)).cast("int"))
    by_instance = tokens.join(_salted(known.select("instance")), ["instance", "salt"], "left_semi")
    by_pattern = tokens.where("seed").withColumn("pattern", F.explode("patterns")).join(_salted(confident.select("pattern")), ["pattern", "salt"], "left_semi")
    added = by_instance.select(*KEY, "start", "end").unionByName(by_pattern.select(*KEY, "start", "end")).distinct().select(*KEY, F.struct(F.col("start"), F.lit(4).alias("kind"), F.col("end")).alias("span"))

    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.count_if(F.col("span.kind") == k).alias(f"n_{KINDS[k]}")
    per_doc = base.unionByName(added).groupBy(*KEY).agg(F.sort_array(F.collect_list("span")).alias("all"), *[count(k) for k in range(5)])
    per_doc = per_doc.select(F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"), *[f"n_{k}" for k in KINDS], text(F.filter("all", lambda s: s["kind"] < 4)).alias("base_text"), text(F.col("all")).alias("spans"))
    out = source.select(*KEY).join(by_key(per_doc), [F.col("doc_id").eqNullSafe(F.col("p_id")), F.col("th") == F.col("p_th")], "left")
    nothing = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *[nothing(f"n_{k}") for k in KINDS[:4]], F.sha2(F.coalesce("base_text", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), nothing("n_context"), sum((F.coalesce(F.col(f"n_{k}"), F.lit(0)) for k in KINDS), F.lit(0)).cast("long").alias("n_spans"))
