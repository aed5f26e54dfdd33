"""Profiles of columns, arrays, maps and tables, from one scan of each table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.labels import truncated

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONS = (T.FloatType, T.DoubleType, T.DecimalType)
#: Distinct values are counted exactly, and shown for at most so many.
SHOWN, FEW = 5, 10
#: Names of the kinds of value ranges.
RANGE_NAMES = {"binary": "binary", "few": f"categorical numeric(no more than {FEW} unique values)", "continuous": "continuous", "other": "categorical or object"}
COLUMN_NAMES = {"binary": "binary", "few": "categorical_numeric", "continuous": "continuous", "other": "categorical"}


def _known(c: Column, kind: T.DataType) -> Column:
    """The value, null for NaN too."""
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


def _group(kind: T.DataType) -> str:
    """The kind of columns that rules tell apart: integer, fraction, boolean, text or other."""
    for name, types in (("integer", INTEGERS), ("fraction", FRACTIONS), ("boolean", T.BooleanType), ("text", T.StringType)):
        if isinstance(kind, types):
            return name
    return "other"


def _key(c: Column, kind: T.DataType) -> Column:
    """A text that tells the values of a type apart: two zeros are one, two hours that a clock shows twice are two."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(c == 0, F.lit(0).cast(kind)).otherwise(c).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    return F.to_json(c) if isinstance(kind, T.VariantType) else c.cast("string")


def _shown(key: Column, dtype: Column) -> Column:
    """A value's text by its key."""
    return F.when(dtype == "timestamp", F.timestamp_micros(key.cast("long")).cast("string")).when(dtype == "binary", F.unhex(key).cast("string")).otherwise(key)


def _listed(table: DataFrame, columns: list[str] | None) -> list[tuple[str, T.DataType]]:
    kinds = {f.name: f.dataType for f in table.schema}
    return [(c, kinds[c]) for c in columns or table.columns]


def value_counts(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """c (the column's place in the list), key, number, n: how often each value of each column occurs, from one scan.

    key is the value as a text, null for nulls and NaN; number is the value of
    numbers and booleans. A row moves as one narrow cell for each column, summed
    up in its task first, so a column of few values moves next to nothing and no
    row is copied whole for each column.
    """
    cells = []
    for k, (name, kind) in enumerate(_listed(table, columns)):
        c = _known(F.col(f"`{name}`"), kind)
        number = c.cast("double") if _group(kind) in ("integer", "fraction", "boolean") else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(k).alias("c"), _key(c, kind).alias("key"), number.alias("number")))
    long = table.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return long.groupBy("c", "key", "number").agg(F.count("*").alias("n"))


def _facts(counts: DataFrame, listed: list[tuple[str, T.DataType]], more: dict[str, Column], values: bool) -> DataFrame:
    """c, column, dtype, kind, length, missing, num_unique, low, high, is_01, the aggregates of `more` over counts, and with `values` smallest: one row for each listed column, an empty one's too.

    The smallest values come from a window over the same counts: its rows beyond
    SHOWN are cut in each task, and Spark reuses the shuffle of the counts.
    """
    known = F.col("key").isNotNull()
    found = counts.groupBy("c").agg(
        F.sum("n").alias("length"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("missing"), F.count("key").alias("num_unique"), F.min("number").alias("low"), F.max("number").alias("high"),
        (F.count_if(known & ~F.coalesce(F.col("number").isin(0.0, 1.0), F.lit(False))) == 0).alias("is_01"), *[a.alias(k) for k, a in more.items()],
    )
    cells = F.array(*[F.struct(F.lit(k).alias("c"), F.lit(name).alias("column"), F.lit(kind.simpleString()).alias("dtype"), F.lit(_group(kind)).alias("kind")) for k, (name, kind) in enumerate(listed)])
    columns = counts.sparkSession.range(1).select(F.explode(cells).alias("x")).select("x.*")
    out = columns.join(F.broadcast(found), "c", "left")  # a row for each column
    if values:
        # keys last that are null, and n, which the first branch needs too: so both read one shuffle
        nth = F.row_number().over(Window.partitionBy("c").orderBy(F.col("key").isNull(), "number", "key"))
        few = counts.withColumn("_n", nth).where((F.col("_n") <= SHOWN) & known)
        few = few.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("_n", "key", "n"))).alias("smallest"))
        out = out.join(F.broadcast(few), "c", "left")
    for name in ("length", "missing", "num_unique"):
        out = out.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def _is_number() -> Column:
    return F.col("kind").isin("integer", "fraction", "boolean")


def _is_binary() -> Column:
    return _is_number() & (F.col("num_unique") == 2) & F.col("is_01")


def _label(names: dict[str, str]) -> Column:
    """What kind of values a row of _facts has. Fractions of a DecimalType count as numbers, booleans too, but not as integers."""
    few = (F.col("kind") == "integer") & (F.col("num_unique") <= FEW)
    return F.when(~_is_number(), names["other"]).when(_is_binary(), names["binary"]).when(few, names["few"]).otherwise(names["continuous"])


def _values() -> Column:
    return F.array_join(F.transform("smallest", lambda x: truncated(_shown(x["key"], F.col("dtype")))), ",")


def _profile(facts: DataFrame, names: dict[str, str]) -> DataFrame:
    return facts.select("column", "dtype", _label(names).alias("type"), "num_unique", "low", "high", (F.col("missing") > 0).alias("has_nan"), "length", F.when(_is_binary(), "0,1").alias("shown"))


def column_profile(table: DataFrame, columns: list[str] | None = None, names: dict[str, str] = COLUMN_NAMES) -> DataFrame:
    """column, dtype, type, num_unique, low, high, has_nan, length, shown: one row for each column, from one scan and two sums.

    Nulls and NaN don't count as values. A constant boolean and an empty
    fraction are continuous; an empty table gives counts of 0 and no range.
    """
    return _profile(_facts(value_counts(table, columns), _listed(table, columns), {}, False), names)


def smallest_values(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, values: the SHOWN smallest distinct values of each column, numbers in their own order, as text, each shortened."""
    facts = _facts(value_counts(table, columns), _listed(table, columns), {}, True)
    return facts.where("smallest IS NOT NULL").select("column", _values().alias("values"))


def _unique_values(names: dict[str, str]) -> Column:
    listed = ~_is_number() if names is COLUMN_NAMES else _label(names) != names["continuous"]
    return F.when(listed & (F.col("num_unique") <= SHOWN), _values())


def _example_values(names: dict[str, str]) -> Column:
    return F.when(~_is_number() & (F.col("num_unique") > SHOWN) & F.lit(names is COLUMN_NAMES), _values())


def with_values(table: DataFrame, columns: list[str] | None = None, names: dict[str, str] = COLUMN_NAMES) -> DataFrame:
    """column_profile with unique_values, where a column has at most SHOWN, and example_values, from the same scan.

    Under RANGE_NAMES all kinds but continuous ones show their unique values.
    Under COLUMN_NAMES only columns of other kinds than numbers do, and show the
    SHOWN smallest as examples where they have more.
    """
    facts = _facts(value_counts(table, columns), _listed(table, columns), {}, True)
    return facts.select("column", "dtype", _label(names).alias("type"), "num_unique", "low", "high", (F.col("missing") > 0).alias("has_nan"), "length", _unique_values(names).alias("unique_values"), _example_values(names).alias("example_values"))


def value_range(table: DataFrame, column: str) -> DataFrame:
    """The value range of one 1-D sequence, under RANGE_NAMES, with its values where they are few."""
    return with_values(table, [column], RANGE_NAMES)


def series(table: DataFrame, column: str) -> DataFrame:
    """type, dtype, length, has_nan."""
    return column_profile(table, [column]).select(F.lit("series").alias("type"), "dtype", "length", "has_nan")


def examples(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, examples: the SHOWN smallest distinct values as text, each shortened. One shuffle by (column, value)."""
    long = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value IS NOT NULL").distinct()
    return _smallest(long).select("column", F.array_join(F.transform("v", lambda x: truncated(x)), "|").alias("examples"))


def _smallest(long: DataFrame) -> DataFrame:
    """The SHOWN smallest values of each column; row_number with a limit is cut in each task before the shuffle."""
    nth = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return long.withColumn("_n", nth).where(F.col("_n") <= SHOWN).groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("v"))


def table_profile(table: DataFrame) -> DataFrame:
    """n_rows, n_columns, has_nan, dtypes (count of columns by dtype, as dtype:count by name)."""
    kinds = [f.dataType for f in table.schema]
    count: dict[str, int] = {}
    for k in kinds:
        count[k.simpleString()] = count.get(k.simpleString(), 0) + 1
    missing = F.lit(False)
    for f in table.schema:
        missing = missing | _known(F.col(f"`{f.name}`"), f.dataType).isNull()
    return table.agg(F.count("*").alias("n_rows"), F.coalesce(F.max(missing), F.lit(False)).alias("has_nan")).select("n_rows", F.lit(len(kinds)).cast("long").alias("n_columns"), "has_nan", F.lit(",".join(f"{k}:{count[k]}" for k in sorted(count))).alias("dtypes"))


def array_profile(values: Column) -> Column:
    """length, has_nan, low, high of a numeric array, NaN and nulls left out of the range; `empty` where it has no element."""
    known = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    return F.struct(
        F.size(values).cast("long").alias("length"), F.exists(values, lambda x: x.isNull() | F.isnan(x.cast("double"))).alias("has_nan"),
        F.array_min(known).cast("double").alias("low"), F.array_max(known).cast("double").alias("high"), (F.size(values) == 0).alias("empty"),
    )


def shape_of(*arrays: Column) -> Column:
    """The shape of nested arrays by the size at each level, as text."""
    return F.concat(F.lit("("), F.concat_ws(", ", *[F.size(a).cast("string") for a in arrays]), F.lit(")"))


def nested_array_profile(value: Column, kind: T.ArrayType) -> Column:
    """shape, dtype, has_nan, low, high, empty of an array of arrays of type `kind`, of any depth.

    The shape ends at the first level whose arrays differ in length (a null one
    differs from all) or are empty. NaN and nulls, whole arrays too, are left
    out of the range and count for has_nan. Elements that are no numbers have
    neither range nor has_nan.
    """
    whole, flat, inner, gap = F.size(value) > 0, value, kind.elementType, F.lit(False)
    sizes = [F.size(value)]
    while isinstance(inner, T.ArrayType):
        lengths = F.transform(flat, lambda x: F.coalesce(F.when(x.isNotNull(), F.size(x)), F.lit(-1)))
        whole = whole & (F.array_min(lengths) == F.array_max(lengths)) & (F.array_min(lengths) >= 0)
        sizes.append(F.when(whole, F.array_min(lengths)))
        whole, gap = whole & (F.array_min(lengths) > 0), gap | F.exists(flat, lambda x: x.isNull())
        flat, inner = F.flatten(F.filter(flat, lambda x: x.isNotNull())), inner.elementType
    end = F.when(sizes[1].isNull() if len(sizes) > 1 else F.lit(True), ",)").otherwise(")")
    shape = F.concat(F.lit("("), F.concat_ws(", ", *[s.cast("string") for s in sizes]), end)
    numeric = isinstance(inner, INTEGERS + FRACTIONS)
    known = F.filter(flat, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))) if numeric else None
    low, high = (f(known).cast("double") if numeric else F.lit(None).cast("double") for f in (F.array_min, F.array_max))
    has_nan = gap | F.exists(flat, lambda x: x.isNull() | F.isnan(x.cast("double"))) if numeric else F.lit(None).cast("boolean")
    return F.when(value.isNotNull(), F.struct(shape.alias("shape"), F.lit(inner.simpleString()).alias("dtype"), has_nan.alias("has_nan"), low.alias("low"), high.alias("high"), (F.size(flat) == 0).alias("empty")))


def tensor_profile(value: Column, kind: T.ArrayType, device: Column, requires_grad: Column) -> Column:
    """shape, dtype, device, requires_grad, has_nan of a recorded tensor; a tensor shows no range."""
    p = nested_array_profile(value, kind)
    return F.when(value.isNotNull(), F.struct(p["shape"].alias("shape"), p["dtype"].alias("dtype"), device.alias("device"), requires_grad.alias("requires_grad"), p["has_nan"].alias("has_nan")))


def _json_type(value: Column) -> Column:
    """Python's name for the type of a value given as JSON; what is no JSON is a text."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    return (
        F.when(kind == "BOOLEAN", "bool").when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int").when(kind.isin("DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), "float")
        .when(F.startswith(kind, F.lit("ARRAY")), "list").when(F.startswith(kind, F.lit("OBJECT")), "dict").when(kind == "VOID", "NoneType").otherwise("str")
    )


def primitive_value(value: Column) -> Column:
    """The value, as text, of a number, a text or a truth value given as JSON; null for lists, objects and null."""
    return F.when(_json_type(value).isin("bool", "int", "float", "str"), F.coalesce(F.try_variant_get(F.try_parse_json(value), "$", "string"), value))


def _json_shape(value: Column, levels: int = 4) -> Column:
    """The shape of nested JSON lists, by each level's first element; null for what is no list."""
    level = F.from_json(value, "array<string>")
    sizes = []
    for _ in range(levels):
        sizes.append(F.size(level).cast("string"))
        level = F.from_json(F.try_element_at(level, F.lit(1)), "array<string>")
    return F.when(F.from_json(value, "array<string>").isNotNull(), F.concat(F.lit("("), F.concat_ws(", ", *sizes), F.when(F.element_at(F.array(*sizes), 2).isNull(), ",)").otherwise(")")))


def collection_length(value: Column) -> Column:
    return F.cardinality(value).cast("long")


def map_profile(entries: Column) -> Column:
    """length, detected, keys, n_epochs, data_shape, target_shape, preview, value_types of a map of JSON texts.

    In this order: a non-empty map of equally long lists of numbers is a
    training history, one with `data` and `target` a dataset, one of numbers
    alone (an empty one too) scalar metrics; any other is previewed by its
    first five entries, keys (always texts) cut at 30 and values at 50
    characters, and the values' types. Shapes are those of nested lists.
    """
    values, keys = F.map_values(entries), F.map_keys(entries)
    as_list = lambda v: F.from_json(v, "array<double>", {"mode": "PERMISSIVE"})
    is_list = lambda v: v.rlike("^\\s*\\[\\s*(-?[0-9][0-9.eE+-]*\\s*(,\\s*-?[0-9][0-9.eE+-]*\\s*)*)?\\]\\s*$")
    length = lambda v: F.size(as_list(v))
    history = (F.size(values) > 0) & F.forall(values, is_list) & (F.size(F.array_distinct(F.transform(values, length))) == 1)
    dataset = F.array_contains(keys, "data") & F.array_contains(keys, "target")
    scalar = F.forall(values, lambda v: v.rlike("^\\s*(-?[0-9][0-9.eE+-]*|true|false)\\s*$"))
    detected = F.when(history, "training_history_dict").when(dataset, "sklearn_dataset_dict").when(scalar, "scalar_metrics_dict")
    preview = F.array_join(F.transform(F.slice(F.map_entries(entries), 1, 5), lambda e: F.concat(truncated(e["key"], 30), F.lit("="), truncated(e["value"], 50))), ";")
    return F.struct(
        F.size(values).cast("long").alias("length"), detected.alias("detected"), F.array_join(keys, ",").alias("keys"),
        F.when(history, length(F.element_at(values, 1))).cast("long").alias("n_epochs"), *[F.when(detected == "sklearn_dataset_dict", _json_shape(F.try_element_at(entries, F.lit(k)))).alias(f"{k}_shape") for k in ("data", "target")],
        F.when(detected.isNull(), preview).alias("preview"), F.when(detected.isNull(), F.array_join(F.transform(F.slice(values, 1, 5), _json_type), ";")).alias("value_types"),
    )


def sampled_shapes(rows: DataFrame, fields: list[str], order: str, most: int = 10) -> DataFrame:
    """field, sizes: the distinct sizes of array fields among the first `most` rows by `order`."""
    few = rows.orderBy(order).limit(most)
    long = few.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(f).alias("n")) for f in fields])).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.array_join(F.sort_array(F.collect_set("n")).cast("array<string>"), ",").alias("sizes"))


def callable_profile(signature: Column, doc: Column, source: Column, user_defined: Column, stored: Column | None = None) -> Column:
    """Recorded metadata of a callable; the source only of user-defined functions, and where it could not be read (null) the stored one of its name."""
    return F.struct(signature.alias("signature"), doc.alias("doc"), F.when(user_defined, F.coalesce(source, stored) if stored is not None else source).alias("source"))


def with_stored_sources(callables: DataFrame, stored: DataFrame) -> DataFrame:
    """callables (instance, name, signature, doc, source, user_defined) with `callable`: callable_profile, sources that could not be read taken from stored (instance, name, source), where a name that stands twice has its last source by text."""
    kept_ = stored.groupBy("instance", "name").agg(F.max("source").alias("_stored"))
    out = callables.join(kept_, ["instance", "name"], "left")
    return out.withColumn("callable", callable_profile(F.col("signature"), F.col("doc"), F.col("source"), F.col("user_defined"), F.col("_stored"))).drop("_stored")


@dataclass(frozen=True)
class Rule:
    """What a run says of a column.

    facts: by key, expressions over a row of column facts (column, dtype, kind,
    length, missing, num_unique, low, high, is_01, smallest where `values` is
    set, and the rule's own aggregates). aggregates: by name, aggregates over
    the rows of value_counts of one column (key, number, n). kinds: of which
    columns the rule speaks, of all if it names none.
    """

    facts: Callable[[], dict[str, Column]]
    aggregates: Callable[[], dict[str, Column]] = dict
    kinds: tuple[str, ...] = ()
    values: bool = False


#: Rules by name; a run applies the enabled ones together, and of several that set a key for a column the last by name counts.
RULES: dict[str, Rule] = {
    "summarize_columns": Rule(lambda: {"dtype": F.col("dtype"), "type": _label(COLUMN_NAMES), "num_unique": F.col("num_unique")}),
    "summarize_frequent": Rule(lambda: {"most_frequent": truncated(_shown(F.col("_frequent"), F.col("dtype")))}, lambda: {"_frequent": F.min_by("key", F.when(F.col("key").isNotNull(), F.struct(-F.col("n"), F.col("key"))))}, ("text", "integer", "boolean")),
    "summarize_means": Rule(lambda: {"mean": F.round("_mean", 6)}, lambda: {"_mean": F.sum(F.col("number") * F.col("n")) / F.sum(F.when(F.col("number").isNotNull(), F.col("n")))}, ("integer", "fraction", "boolean")),
    "summarize_nulls": Rule(lambda: {"has_nan": F.col("missing") > 0, "missing": F.col("missing")}),
    "summarize_ranges": Rule(lambda: {"type": _label(RANGE_NAMES), "low": F.col("low"), "high": F.col("high")}),
    "summarize_texts": Rule(lambda: {"shortest": F.col("_shortest"), "longest": F.col("_longest")}, lambda: {"_shortest": F.min(F.length("key")), "_longest": F.max(F.length("key"))}, ("text",)),
    "summarize_values": Rule(lambda: {"unique_values": _unique_values(COLUMN_NAMES), "example_values": _example_values(COLUMN_NAMES)}, values=True),
}


def apply_rules(table: DataFrame, enabled: list[str], columns: list[str] | None = None) -> DataFrame:
    """column, key, value (as text) of the enabled rules: facts that are null are left out, names of unknown rules passed by. One scan of the table, whatever the number of rules."""
    rules = {n: RULES[n] for n in sorted(set(enabled)) if n in RULES}
    facts: dict[str, Column] = {}
    more: dict[str, Column] = {}
    for r in rules.values():
        more |= r.aggregates()
        here = F.col("kind").isin(*r.kinds) if r.kinds else F.lit(True)
        for key, fact in r.facts().items():
            text = F.when(here, fact.cast("string"))
            facts[key] = F.coalesce(text, facts[key]) if key in facts else text
    rows = _facts(value_counts(table, columns), _listed(table, columns), more, any(r.values for r in rules.values()))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in facts.items()]) if facts else F.expr("CAST(array() AS array<struct<key:string,value:string>>)")
    return rows.select("column", F.explode(pairs).alias("x")).select("column", "x.*").where("value IS NOT NULL")
