"""Chains of subsets against plain loops, and recorded metadata of odd records."""

import random

from pyspark.sql import functions as F

from verdigris.operators import datasets


def plain_places(parents, sizes, index, most):
    out = set()
    for d in parents:
        for pos in range(min(most, sizes[d])):
            at, here, met = pos, d, set()
            while parents.get(here) is not None and here not in met:
                met.add(here)
                own = index[here]
                if at not in own or parents[here] not in sizes:
                    break
                at, here = own[at], parents[here]
                at += sizes[here] if at < 0 else 0
                if not 0 <= at < sizes[here]:
                    break
            else:
                if here not in met:
                    out.add((d, pos, here, at))
    return out


def test_chains_equal_plain_loops(spark):
    r = random.Random(6)
    for _ in range(3):
        parents, sizes, index = {"b0": None, "b1": None, "empty": None}, {"b0": 30, "b1": 3, "empty": 0}, {}
        for k in range(12):
            parents[f"s{k}"] = r.choice([*parents, "absent"])
            sizes[f"s{k}"] = r.randint(0, 15)
            n = sizes.get(parents[f"s{k}"], 5)
            index[f"s{k}"] = {p: r.randint(-n - 1, n) for p in range(sizes[f"s{k}"]) if r.random() < 0.95}
        for a, b in (("c0", "c1"), ("c1", "c0")):  # a circle
            parents[a], sizes[a], index[a] = b, 4, {p: p for p in range(4)}
        known = spark.createDataFrame([(d, p, sizes[d]) for d, p in parents.items()] + [("b0", None, 30)], "dataset string, parent string, length long")
        indices = spark.createDataFrame([(d, p, i) for d, own in index.items() for p, i in own.items()], "dataset string, pos long, index long")
        for most in (10, 3):
            got = {tuple(x) for x in datasets.sample_places(known, indices, most).select("dataset", "pos", "base", "place").collect()}
            assert got == plain_places(parents, sizes, index, most)


def test_shapes_and_batches(spark):
    places = spark.createDataFrame([("s", 0, "b", 2), ("s", 1, "b", 0), ("b", 0, "b", 0)], "dataset string, pos long, base string, place long")
    samples = [("b", 0, 0, "(3, 4)"), ("b", 2, 0, "(3, 4)"), ("b", 0, 1, "()"), ("b", 2, 1, "()"), ("b", 0, 2, "str"), ("b", 2, 2, "str"), ("b", 0, 3, "(1,)"), ("b", 2, 3, "(2,)"), ("b", 9, 0, "(9,)")]
    rows = spark.createDataFrame(samples, "dataset string, place long, j int, shape string").select("dataset", "place", datasets.field_name(F.col("j")).alias("field"), "shape")
    got = {(r.dataset, r.field): (r.shapes, r.n, r.batch_shape) for r in datasets.sample_shapes(places, rows).collect()}
    assert got == {
        ("s", "input"): (["(3, 4)"], 2, "(2, 3, 4)"), ("s", "label"): (["()"], 2, "(2,)"), ("s", "field[2]"): (["str"], 2, None), ("s", "field[3]"): (["(1,)", "(2,)"], 2, None),
        ("b", "input"): (["(3, 4)"], 1, "(1, 3, 4)"), ("b", "label"): (["()"], 1, "(1,)"), ("b", "field[2]"): (["str"], 1, None), ("b", "field[3]"): (["(1,)"], 1, "(1, 1)"),
    }
    ranked = datasets.base_places(spark.createDataFrame([("a", 5), ("a", 3), ("a", 9), ("b", 1)], "d string, o int"), "d", "o", 2)
    assert sorted((r.d, r.o, r.place) for r in ranked.collect()) == [("a", 3, 0), ("a", 5, 1), ("b", 1, 0)]


def test_records_of_odd_forms(spark):
    rows = [
        ("none", "torch.utils.data", "DataLoader", None), ("broken", "torch.utils.data", "DataLoader", "{"), ("list", "keras.x", "DataFrameIterator", '{"class_indices": [1, 2, 3], "n": "7", "image_shape": [4]}'), ("other", "numpy", "ndarray", "{}"),
        ("unfit", "sklearn.svm", "SVC", '{"C": 1}'), ("null", None, None, "{}"), ("deep", "keras.src.legacy.image", "DirectoryIterator", '{"n": {"a": 1}, "image_shape": "odd", "target_size": []}'),
    ]
    got = {}
    for r in datasets.recorded_metadata(spark.createDataFrame(rows, "name string, module string, class_name string, attributes string")).collect():
        got.setdefault((r.name, r.kind), {})[r.key] = r.value
    assert got[("none", "loader")] == got[("broken", "loader")] == {"type": "torch.utils.data.DataLoader", "num_batches": None, "num_examples": None, "batch_size": None, "dataset_type": None}
    frame = got[("list", "frame_iterator")]
    assert (frame["num_classes"], frame["n_samples"], frame["image_shape"], frame["samples"]) == ("3", "7", "(4,)", None)
    assert got[("unfit", "estimator")] == {"class_name": "SVC", "module": "sklearn.svm", "is_fitted": "false"} and len(got) == 5
    assert got[("deep", "directory_iterator")]["image_shape"] == "odd" and got[("deep", "directory_iterator")]["target_size"] == "()"
