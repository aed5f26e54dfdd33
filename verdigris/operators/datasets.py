"""Samples of recorded datasets through chains of subsets, and recorded metadata of loaders, iterators and estimators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.sources.scratch import kept

#: Fixed value: samples looked at of each dataset.
SAMPLES = 10


# -- samples ---------------------------------------------------------------

def sample_places(datasets: DataFrame, indices: DataFrame, most: int = SAMPLES) -> DataFrame:
    """dataset, pos, base, place: the first `most` positions of each dataset, and where in a base dataset each of them leads.

    datasets: dataset, parent (null for a base), length; indices: dataset, pos,
    index, what a subset takes from its parent. A subset may be one of a subset,
    to any depth: each round takes all positions that are not at a base yet one
    dataset up, by a join on (dataset, position), so only positions that are
    asked for meet the indices. A negative index counts from the end. Positions
    that lead outside a dataset, or to one that is not listed, are left out, as
    are subsets in a circle.
    """
    known = datasets.select("dataset", "parent", "length").dropDuplicates(["dataset"])
    heads = known.select(F.col("dataset").alias("asked"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))).alias("pos"), "dataset", "parent", "length").where("pos < length")
    rows = kept(heads.select("*", F.col("pos").alias("place"), F.array("asked").alias("way")), "places")
    links = indices.select("dataset", F.col("pos").alias("place"), "index")
    up = known.select(F.col("dataset").alias("parent"), F.col("parent").alias("above"), F.col("length").alias("size"))
    at_base = lambda rows: rows.where("parent IS NULL").select(F.col("asked").alias("dataset"), "pos", F.col("dataset").alias("base"), "place")
    found, open_ = at_base(rows), rows.where("parent IS NOT NULL")
    while not open_.isEmpty():
        moved = open_.where("NOT array_contains(way, parent)").join(links, ["dataset", "place"]).join(up, "parent")
        at = F.when(F.col("index") < 0, F.col("index") + F.col("size")).otherwise(F.col("index"))
        moved = moved.select("asked", "pos", F.col("parent").alias("dataset"), F.col("above").alias("parent"), F.col("size").alias("length"), at.alias("place"), F.array_append("way", F.col("parent")).alias("way"))
        rows = kept(moved.where("place >= 0 AND place < length"), "places")
        found, open_ = found.unionByName(at_base(rows)), rows.where("parent IS NOT NULL")
    return found


def base_places(rows: DataFrame, dataset: str, order: str, most: int) -> DataFrame:
    """rows with place long, their position by `order` in their base dataset, of the first `most` rows of each: cut in each task before anything moves."""
    nth = F.row_number().over(Window.partitionBy(dataset).orderBy(order))
    return rows.withColumn("place", nth.cast("long")).where(F.col("place") <= most).withColumn("place", F.col("place") - 1)


def field_name(number: Column) -> Column:
    """input and label for the first two fields of a sample that is a tuple, field[n] for the others."""
    return F.when(number == 0, "input").when(number == 1, "label").otherwise(F.concat(F.lit("field["), number.cast("string"), F.lit("]")))


def sample_shapes(places: DataFrame, samples: DataFrame) -> DataFrame:
    """dataset, field, shapes, n, batch_shape of the places (see sample_places).

    samples: dataset, place, field, shape: the shape of each field of each stored
    sample as text, `(3, 4)`, or a type's name. shapes: the different ones in
    text order; n: samples with the field; batch_shape: that of the samples put
    together, null where their shapes differ or are no shapes.
    """
    met = places.select(F.col("dataset").alias("asked"), F.col("base").alias("dataset"), "place", "pos").join(samples, ["dataset", "place"])
    out = met.groupBy(F.col("asked").alias("dataset"), "field").agg(F.collect_set("shape").alias("s"), F.count("*").alias("n"))
    one, inner = F.element_at("s", 1), F.regexp_extract(F.element_at("s", 1), "^\\((.*?),?\\)$", 1)
    batch = F.when((F.size("s") == 1) & F.startswith(one, F.lit("(")), F.concat(F.lit("("), F.col("n").cast("string"), F.when(inner == "", ",)").otherwise(F.concat(F.lit(", "), inner, F.lit(")")))))
    return out.select("dataset", "field", F.array_sort("s").alias("shapes"), "n", batch.alias("batch_shape"))


# -- recorded metadata -----------------------------------------------------

def _class(name: Column, module: Column) -> Column:
    return F.concat(module, F.lit("."), name)


def kind_of_record(module: Column, name: Column) -> Column:
    """What a recorded object is, by its class: directory_iterator, dataset, frame_iterator, loader, estimator or null."""
    return (
        F.when((name == "DirectoryIterator") & module.contains("keras"), "directory_iterator").when(name == "DataFrameIterator", "frame_iterator")
        .when(F.endswith(name, F.lit("Dataset")) & F.startswith(module, F.lit("tensorflow.")), "dataset").when((name == "DataLoader") & F.startswith(module, F.lit("torch.utils.data")), "loader")
        .when(F.startswith(module, F.lit("sklearn.")), "estimator")
    )


#: By kind, what is told of a record: key, path in its attributes, and how its value is read.
PATHS = {
    "directory_iterator": [("n_samples", "$.n", "text"), ("num_classes", "$.num_classes", "text"), ("batch_size", "$.batch_size", "text"), ("image_shape", "$.image_shape", "shape"), ("target_size", "$.target_size", "shape")],
    "dataset": [("type", None, "type"), ("element_spec", "$.element_spec", "text")],
    "frame_iterator": [("type", None, "type"), ("n_samples", "$.n", "text"), ("samples", "$.samples", "text"), ("batch_size", "$.batch_size", "text"), ("image_shape", "$.image_shape", "shape"), ("class_mode", "$.class_mode", "text"), ("num_classes", "$.class_indices", "size")],
    "loader": [("type", None, "type"), ("num_batches", "$.length", "text"), ("num_examples", "$.dataset.length", "text"), ("batch_size", "$.batch_size", "text"), ("dataset_type", "$.dataset.type", "text")],
    "estimator": [("class_name", None, "name"), ("module", None, "module"), ("is_fitted", None, "fitted"), ("n_features_in_", "$.n_features_in_", "fitted text"), ("n_outputs_", "$.n_outputs_", "fitted text")],
}


def _is_fitted(attributes: Column) -> Column:
    """Whether some attribute ends with one underscore and does not begin with two: what fitting leaves behind."""
    names = F.json_object_keys(F.to_json(attributes))
    return F.coalesce(F.exists(names, lambda n: F.endswith(n, F.lit("_")) & ~F.startswith(n, F.lit("__"))), F.lit(False))


def _shape_text(value: Column) -> Column:
    """A recorded list of sizes as a shape."""
    sizes = F.try_variant_get(value, "$", "array<long>")
    return F.when(sizes.isNotNull(), F.concat(F.lit("("), F.array_join(sizes.cast("array<string>"), ", "), F.when(F.size(sizes) == 1, ",)").otherwise(")")))


def recorded_metadata(records: DataFrame, name: str = "name", module: str = "module", class_name: str = "class_name", attributes: str = "attributes") -> DataFrame:
    """name, kind, key, value (text): what PATHS tells of each record, by the kind of its class; records of other classes have no rows.

    attributes: a JSON text of what was recorded of the object, read by path, so
    records of any form stand in one table. A field that is absent or null has a
    row without a value; so has each field where the text is no JSON. Counts of
    maps and lists are their sizes; an estimator's learnt fields are told where
    it is fitted alone.
    """
    at = F.col("_attributes")
    rows = records.select(F.col(name).alias("name"), F.col(module).alias("_module"), F.col(class_name).alias("_class"), F.try_parse_json(attributes).alias("_attributes"))
    rows = rows.withColumn("kind", kind_of_record(F.col("_module"), F.col("_class"))).where("kind IS NOT NULL")
    text = lambda path: F.try_variant_get(at, path, "string")

    def read(path: str | None, how: str) -> Column:
        if how == "size":
            whole = F.try_variant_get(at, path, "variant")
            return F.coalesce(F.size(F.try_variant_get(whole, "$", "map<string,variant>")), F.size(F.try_variant_get(whole, "$", "array<variant>"))).cast("string")
        return {
            "text": lambda: text(path), "shape": lambda: F.coalesce(_shape_text(F.try_variant_get(at, path, "variant")), text(path)), "type": lambda: _class(F.col("_class"), F.col("_module")), "name": lambda: F.col("_class"),
            "module": lambda: F.col("_module"), "fitted": lambda: _is_fitted(at).cast("string"), "fitted text": lambda: F.when(_is_fitted(at), text(path)),
        }[how]()

    told = None
    for kind, fields in PATHS.items():
        pairs = F.array(*[F.struct(F.lit(key).alias("key"), read(path, how).alias("value")) for key, path, how in fields if not (kind == "estimator" and how == "fitted text")])
        if kind == "estimator":  # learnt fields have rows where there is something learnt
            learnt = F.array(*[F.struct(F.lit(key).alias("key"), read(path, how).alias("value")) for key, path, how in fields if how == "fitted text"])
            pairs = F.when(_is_fitted(at), F.concat(pairs, learnt)).otherwise(pairs)
        told = F.when(F.col("kind") == kind, pairs) if told is None else told.when(F.col("kind") == kind, pairs)
    return rows.select("name", "kind", F.explode(told).alias("x")).select("name", "kind", "x.*")
