"""Cases that the test tables lack: ties, nulls, one-sided keys, support limits, branch orders."""

import math

import pytest
from pyspark.sql import functions as F

from verdigris.functions import labels as L
from verdigris.functions import text as X
from verdigris.functions.code import definitions_in, dependencies_in, functions_in, literal_types, strip_comments
from verdigris.operators import aliases, diagnostics, grading, metrics, profile, sequence, summary, votes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def long_labels(spark, cells):
    return spark.createDataFrame([(k, i, x) for k, xs in cells.items() for i, x in enumerate(xs)], "k string, pos int, label string")


def test_vote_ties_go_to_the_first_seen(spark):
    cells = {"1": list("baba"), "2": list("abab"), "3": ["c"], "4": [None, "x", None], "5": [None]}
    got = {r.k: r.vote for r in votes.majority_vote(long_labels(spark, cells), ["k"], "label", "pos").collect()}
    assert got == {"1": "b", "2": "a", "3": "c", "4": "x"}
    last = {r.k: r.vote for r in votes.majority_vote(long_labels(spark, cells), ["k"], "label", "pos", last_wins=True).collect()}
    assert last["1"] == "a" and last["2"] == "b"


def test_vote_of_keys_without_labels_is_empty(spark):
    keys = spark.createDataFrame([("1",), ("9",)], "k string")
    got = {r.k: (r.vote, r.n_votes) for r in votes.majority_vote(long_labels(spark, {"1": ["a"]}), ["k"], "label", "pos", keys).collect()}
    assert got == {"1": ("a", 1), "9": ("", 0)}


def test_vote_in_the_order_of_texts_and_times(spark):
    df = spark.createDataFrame([("k", "b", "02"), ("k", "a", "01"), ("k", "c", "03")], "k string, label string, at string")
    for order in (df, df.withColumn("at", F.to_timestamp(F.concat(F.lit("2024-01-"), "at"))), df.withColumn("at", F.to_date(F.concat(F.lit("2024-01-"), "at")))):
        assert [r.vote for r in votes.majority_vote(order, ["k"], "label", "at").collect()] == ["a"]
        assert [r.vote for r in votes.majority_vote(order, ["k"], "label", "at", last_wins=True).collect()] == ["c"]


def test_vote_on_an_empty_table(spark):
    assert votes.majority_vote(spark.createDataFrame([], "k string, pos int, label string"), ["k"], "label", "pos").count() == 0


def test_grades(spark):
    forms = {"[Correct]": "[Correct]", " text [ partially correct ] more": "[Partially correct]", "[]": "Cannot verify: []", "plain": "Cannot extract detection labels: plain", "[odd]": "Cannot verify: [odd]", None: "Cannot extract detection labels: None", "[wro\nng]": "Cannot extract detection labels: [wro\nng]", "[\tWRONG ]": "[Wrong]"}
    df = spark.createDataFrame([(k,) for k in forms], "a string").select("a", L.normalize_grade(F.col("a")).alias("g"))
    assert {r.a: r.g for r in df.collect()} == forms


def test_bare_grades_differ_in_inner_quotes(spark):
    assert one(spark, L.bare_grade(F.lit("'[It's]'"))) == "it's"
    assert one(spark, L.bare_grade_unquoted(F.lit("'[It's]'"))) == "its"


def test_outer_join_keeps_both_sides_and_missing_never_matches(spark):
    a = spark.createDataFrame([("x", "p"), ("y", None), ("z", "q")], "k string, v string")
    b = spark.createDataFrame([("y", None), ("z", "q"), ("w", "r")], "k string, v string")
    got = {r.k: (r.v_a, r.v_b, r.match) for r in summary.match_flags(summary.suffixed_outer(a, b, "k", ("_a", "_b")), "v_a", "v_b").collect()}
    assert got == {"x": ("p", None, False), "y": (None, None, False), "z": ("q", "q", True), "w": (None, "r", False)}


def test_instance_order_is_numeric_and_fixed_first(spark):
    keys = ["a_10_fixed", "a_2_fixed", "a_1_reproduced", "a_1_odd", "B_1_fixed"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r.k for r in df.orderBy(*L.instance_order(F.col("k"))).collect()] == ["B_1_fixed", "a_2_fixed", "a_10_fixed", "a_1_reproduced", "a_1_odd"]


def test_rates_need_support(spark):
    rows = [("four", "correct", None)] * 4 + [("five", "correct", "correct")] * 3 + [("five", None, "wrong")] * 2
    got = metrics.rates_by_cause(spark.createDataFrame(rows, "c string, w string, o string"), ["c"], "w", "o").collect()
    assert [(r.c, r.n, r.with_rate, r.without_rate) for r in got] == [("five", 5, 0.6, 0.6)]


def test_kappa(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b"), ("b", "b"), (None, "a"), ("a", None)], "h string, j string")
    r = metrics.kappa(pairs, [], "h", "j").collect()[0]
    expected = (2 * 1 + 1 * 3) / 16
    assert (r.n, r.agreed) == (4, 2) and math.isclose(r.kappa, (0.5 - expected) / (1 - expected))
    assert metrics.kappa(spark.createDataFrame([("a", "a")], "h string, j string"), [], "h", "j").collect()[0].kappa is None


def test_accuracy_without_pairs_is_zero(spark):
    r = metrics.accuracy(spark.createDataFrame([("g", None, "x")], "g string, h string, p string"), ["g"], "h", "p").collect()[0]
    assert (r.n, r.mismatches, r.accuracy) == (0, 0, 0.0)


def test_long_pairs_skip_missing_columns(spark):
    wide = spark.createDataFrame([("i", "a", "b")], "instance string, h string, p string")
    got = metrics.long_pairs(wide, "instance", [("s", "code", "h", "p"), ("s", "info", "h", "absent")]).collect()
    assert [tuple(r) for r in got] == [("i", "s", "code", "a", "b")]


def test_filters_are_safe_against_nulls(spark):
    rows = [("error", None, "fine"), ("error", "import-error", "fine"), ("error", None, "Module 'cv2' has no 'imread' member"), ("error", "x", "say Module 'cv2' has no 'imread' member"), ("warning", "x", "fine"), (None, "x", "fine")]
    df = spark.createDataFrame(rows, "type string, symbol string, message string")
    assert [r.message for r in df.where(diagnostics.keeps_a(F.col("type"), F.col("symbol"), F.col("message"))).collect()] == ["fine", "say Module 'cv2' has no 'imread' member"]
    rows = [("error", None, "x Expected expression y"), ("error", None, "ok"), ("error", "reportMissingImports", "ok"), ("error", "r", None)]
    df = spark.createDataFrame(rows, "severity string, rule string, message string")
    assert df.where(diagnostics.keeps_b(F.col("severity"), F.col("rule"), F.col("message"))).count() == 2


def test_filtered_arrays(spark):
    df = spark.range(1).select(F.from_json(F.lit('[{"code_line":"1: x","message":"m","symbol":null,"type":"error","source":"s"},{"message":"m","symbol":"syntax-error","type":"error"}]'), "array<struct<code_line:string,message:string,symbol:string,type:string,source:string>>").alias("d"))
    assert df.select(F.size(diagnostics.filtered_array_a(F.col("d")))).collect()[0][0] == 1


def test_code_lines_outside_are_empty(spark):
    assert one(spark, diagnostics.code_line_a(F.lit("a\nb"), F.lit(2))) == "2: b"
    assert one(spark, diagnostics.code_line_a(F.lit("a\nb"), F.lit(9))) == "9: "
    assert one(spark, diagnostics.code_line_b(F.lit("a\nb"), F.lit(0))) == "1: a"


def test_profile_branches(spark):
    schema = "b boolean, t boolean, z double, f double, i5 int, i11 int, n double, e int"
    rows = [(True, True, float(k % 2), float(k % 3), k % 5, k % 11, float("nan") if k == 0 else 1.5, None) for k in range(22)]
    rows[0] = (True, False, *rows[0][2:])
    got = {r.column: r for r in profile.column_profile(spark.createDataFrame(rows, schema)).collect()}
    assert {c: r.type for c, r in got.items()} == {"b": "continuous", "t": "binary", "z": "binary", "f": "continuous", "i5": "categorical_numeric", "i11": "continuous", "n": "continuous", "e": "categorical_numeric"}
    assert got["n"].has_nan and got["n"].num_unique == 1 and got["e"].low is None
    assert {r.num_unique for r in profile.column_profile(spark.createDataFrame([], schema)).collect()} == {0}


def test_array_profile_leaves_nan_out(spark):
    p = one(spark, profile.array_profile(F.array(F.lit(1.0), F.lit(float("nan")), F.lit(-2.0))))
    assert (p.length, p.has_nan, p.low, p.high, p.empty) == (3, True, -2.0, 1.0, False)
    assert one(spark, profile.array_profile(F.array().cast("array<double>"))).empty


def test_map_profile_order(spark):
    kinds = {'{"loss": [1, 2], "acc": [0.5, 0.6]}': "training_history_dict", '{"data": "x", "target": "y"}': "sklearn_dataset_dict", "{}": "scalar_metrics_dict", '{"a": 1.5}': "scalar_metrics_dict", '{"a": [1], "b": [1, 2]}': None}
    df = spark.createDataFrame([(k,) for k in kinds], "j string").select("j", profile.map_profile(F.from_json("j", "map<string,string>")).alias("p"))
    assert {r.j: r.p.detected for r in df.collect()} == kinds


def test_nested_arrays(spark):
    df = spark.createDataFrame([(1, [[1.0, float("nan")], [3.0, -2.0]], [["a"]]), (2, [], []), (3, None, None)], "i int, x array<array<double>>, s array<array<string>>")
    got = {r.i: r for r in df.select("i", profile.nested_array_profile(F.col("x"), df.schema["x"].dataType).alias("x"), profile.nested_array_profile(F.col("s"), df.schema["s"].dataType).alias("s"), profile.tensor_profile(F.col("x"), df.schema["x"].dataType, F.lit("cpu"), F.lit(True)).alias("t")).collect()}
    assert tuple(got[1].x) == ("(2, 2)", "double", True, -2.0, 3.0, False) and tuple(got[2].x) == ("(0,)", "double", False, None, None, True) and got[3].x is None
    assert tuple(got[1].s) == ("(1, 1)", "string", None, None, None, False) and tuple(got[1].t) == ("(2, 2)", "double", "cpu", True, True)


def test_positions_of_a_whole_table(spark):
    """Numbered by ranges: the rows and positions of a sort, ties numbered apart, and no window."""
    rows = [((k * 7) % 10 if k % 3 else None, f"v{k % 4}", {"a": k}) for k in range(300)] + [(5, "tie", None)] * 200
    df = spark.createDataFrame(rows, "n int, s string, m map<string,int>").repartition(7)
    for order in ([F.col("n").desc_nulls_last(), F.col("s")], [F.col("s").desc()], [F.lit(1)]):
        out = summary.positioned(df, order)
        got = out.orderBy("position").collect()
        assert [r.position for r in got] == list(range(1, 501)) and out.columns == ["n", "s", "m", "position"]
        assert "Window" not in plan_of(out)
        if len(order) == 2:
            assert [(r.n, r.s) for r in got] == sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert summary.positioned(df.limit(0), [F.col("n")]).collect() == []
    within = summary.positioned(df, [F.col("n")], "at", ["s"]).where("s = 'tie'").collect()
    assert sorted(r["at"] for r in within) == list(range(1, 201))


def test_places_that_are_missing_lose_ties(spark):
    df = spark.createDataFrame([("a", "x", None), ("a", "y", 7), ("b", "x", None), ("b", "x", None), ("b", "y", 1)], "k string, v string, o int")
    for last in (False, True):
        assert {r.k: r.vote for r in votes.majority_vote(df, ["k"], "v", "o", last_wins=last).collect()} == {"a": "y", "b": "x"}


def test_updates_of_one_key_must_be_one(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    up = spark.createDataFrame([(1, "x"), (9, "y"), (9, "z"), (2, None)], "k int, v string")
    assert {r.k: r.v for r in summary.scattered(base, up, "k", "v").collect()} == {1: "x", 2: "b", 3: None}
    with pytest.raises(Exception, match="several updates of 1"):
        summary.scattered(base, up.union(up), "k", "v").collect()


def test_callables_with_stored_sources(spark):
    rows = [("n", "f", "(x)", "d", None, True), ("n", "g", None, None, "def g", True), ("n", "h", "()", None, None, False), ("m", "f", None, None, None, True)]
    given = spark.createDataFrame(rows, "instance string, name string, signature string, doc string, source string, user_defined boolean")
    stored = spark.createDataFrame([("n", "f", "def f"), ("n", "g", "old g"), ("n", "h", "def h")], "instance string, name string, source string")
    got = {(r.instance, r.name): r.callable.source for r in profile.with_stored_sources(given, stored).collect()}
    assert got == {("n", "f"): "def f", ("n", "g"): "def g", ("n", "h"): None, ("m", "f"): None}


def test_shapes_of_ragged_and_missing_arrays(spark):
    given = {1: [[[1.0], [2.0]], [[3.0], [None]]], 2: [[[1.0], None]], 3: [[], []], 4: [[[1.0]], []], 5: [None, [[-1.0, 4.0]]], 6: [[[1.0, 2.0], [3.0]]], 7: []}
    df = spark.createDataFrame(list(given.items()), "i int, x array<array<array<double>>>")
    got = {r.i: tuple(r.x) for r in df.select("i", profile.nested_array_profile(F.col("x"), df.schema["x"].dataType).alias("x")).collect()}
    assert {i: (x[0], x[2], x[3], x[4], x[5]) for i, x in got.items()} == {
        1: ("(2, 2, 1)", True, 1.0, 3.0, False), 2: ("(1, 2)", True, 1.0, 1.0, False), 3: ("(2, 0)", False, None, None, True), 4: ("(2,)", False, 1.0, 1.0, False),
        5: ("(2,)", True, -1.0, 4.0, False), 6: ("(1, 2)", False, 1.0, 3.0, False), 7: ("(0,)", False, None, None, True),
    }


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_profiles_scan_once(spark, tmp_path):
    """All rules together read the table once, and no row is expanded for each column's distinct values."""
    rows = [(k, "é" * (k % 7), k % 2 == 0, float(k % 3) if k % 5 else None, None, bytes([k % 3]), [k % 2]) for k in range(200)]
    spark.createDataFrame(rows, "i long, s string, b boolean, f float, e int, raw binary, a array<int>").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t")).withColumn("at", F.timestamp_seconds(F.col("i") % 4))
    for df in (profile.apply_rules(table, list(profile.RULES)), profile.with_values(table)):
        plan = plan_of(df)
        assert plan.count("Scan parquet") == 1 and "Expand" not in plan and "ReusedExchange" in plan
    got = {(r.column, r.key): r.value for r in profile.apply_rules(table, [*profile.RULES, "no_such_rule"]).collect()}
    assert got[("f", "missing")] == "40" and got[("e", "missing")] == "200" and got[("e", "num_unique")] == "0" and ("e", "mean") not in got
    assert (got[("s", "shortest")], got[("s", "longest")], got[("s", "example_values")]) == ("0", "6", ",é,éé,ééé,éééé") and ("i", "longest") not in got
    assert got[("b", "mean")] == "0.5" and got[("b", "type")] == "binary" and got[("raw", "num_unique")] == "3" and got[("a", "unique_values")] == "[0],[1]"
    assert got[("at", "unique_values")].startswith("1970-01-01 00:00:00,1970-01-01 00:00:01") and got[("s", "most_frequent")] == ""
    assert got[("i", "low")] == "0.0" and got[("i", "high")] == "199.0" and profile.apply_rules(table, []).count() == 0
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "z double")
    assert [(r.num_unique, r.has_nan, r.length) for r in profile.column_profile(zeros).collect()] == [(1, True, 4)]
    assert [(r.column, r.key, r.value) for r in profile.apply_rules(zeros.limit(0), ["summarize_nulls"]).collect()] == [("z", "has_nan", "false"), ("z", "missing", "0")]


def test_later_rules_win_for_their_kinds_alone(spark, monkeypatch):
    monkeypatch.setitem(profile.RULES, "zz", profile.Rule(lambda: {"num_unique": F.lit("many")}, kinds=("text",)))
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    got = {(r.column, r.key): r.value for r in profile.apply_rules(df, ["zz", "summarize_columns"]).collect()}
    assert got[("i", "num_unique")] == "1" and got[("s", "num_unique")] == "many"


def test_primitive_values(spark):
    values = {"1": "1", "1.5": "1.5", '"t"': "t", "plain words": "plain words", "true": "true", "[1]": None, '{"a": 1}': None, "null": None}
    df = spark.createDataFrame([(k,) for k in values], "v string")
    assert {r.v: r.p for r in df.select("v", profile.primitive_value(F.col("v")).alias("p")).collect()} == values


def test_merged_maps_and_ground_truth(spark):
    maps = [spark.createDataFrame([("p", i, x) for i, x in rows], "package string, internal string, public string") for rows in ([("p.a", "p.A"), ("p.b", "p.B")], [("p.a", "p.C")])]
    assert {r.internal: r.public for r in aliases.merged_maps(maps).collect()} == {"p.a": "p.C", "p.b": "p.B"}
    df = spark.createDataFrame([(True, "why"), (False, None), (None, "why")], "d boolean, r string")
    assert [r.x for r in df.select(summary.ground_truth_text(F.col("d"), F.col("r")).alias("x")).collect()] == ["\nGround truth: True. why", "\nGround truth: False. ", ""]


def test_rules_merge_by_name(spark):
    got = {(r.column, r.key): r.value for r in profile.apply_rules(spark.createDataFrame([(1,)], "a int"), ["summarize_ranges", "summarize_columns"]).collect()}
    assert got[("a", "type")].startswith("categorical numeric")


def test_split_cells_rules(spark):
    rows = [("n", 0, 3, "a", False), ("n", 1, 9, "# [reexecute]\nb", False), ("n", 2, 5, "c", True), ("n", 3, None, "d", False), ("n", 4, 4, "e", True), ("m", 0, 1, "a", False)]
    cells = spark.createDataFrame(rows, "notebook string, code_cell_id int, execution_count int, code string, has_error boolean")
    got = {(r.notebook, r.code_cell_id): (r.is_target, r.is_executed) for r in sequence.split_cells(cells).collect()}
    assert got == {("n", 0): (False, True), ("n", 1): (False, True), ("n", 2): (True, False), ("n", 3): (False, False), ("n", 4): (False, True), ("m", 0): (False, False)}
    texts = {r.notebook: r.text for r in sequence.prompts(sequence.split_cells(cells), comments=True).collect()}
    assert texts["n"] == "# Executed Cells:\n## Cell 1:\na\n\n## Cell 2:\ne\n\n## Cell 3:\n# [reexecute]\nb\n\n# Target Cell:\nc"
    assert texts["m"] == "# Executed Cells:\nNo cell has been executed\n# Target Cell:\n"


def test_text_functions(spark):
    assert one(spark, X.crash_line(F.lit("\x1b[31m<ipython-input-3-ab> in <cell line: 2>()"), F.lit("x\n  y"))) == "y"
    assert one(spark, X.crash_line(F.lit("none"), F.lit("x"))) is None
    assert one(spark, X.between(F.lit("a# Target Cell:\nb"), X.RUNTIME, X.TARGET)) is None
    assert one(spark, X.between(F.lit(X.RUNTIME + "r"), X.RUNTIME, X.TARGET)) == X.RUNTIME + "r"
    assert one(spark, X.between(F.lit(X.RUNTIME + "r"), X.RUNTIME, X.TARGET, to_the_end=False)) is None
    assert one(spark, X.scrubbed(F.lit("dtype('int') <a.B object at 0x1f> torch.Size([1]) defaultdict(list)"))) == "'int' \"<object>\" \"<torch.Size>\" {}"
    assert one(spark, X.clean_type(F.lit(" <class 'a.B'> "))) == "a.B"
    assert one(spark, X.clean_type(F.lit("<class '<x>'>"))) is None and one(spark, X.clean_type(F.lit(""))) is None
    found = {m.module: m.alias for m in one(spark, X.import_aliases(F.lit("import a.b as c\nimport a.b\nimport d\nfrom e import f")))}
    assert found == {"a.b": "a.b", "a": "a", "d": "d"}
    assert [(m.module, m.alias) for m in one(spark, X.import_aliases(F.lit("if x:\n\timport numpy as np\r")))] == [("numpy", "np")]


def test_code_functions():
    assert strip_comments("x = '# a'  # b\ny") == "x = '# a'\ny" and strip_comments(None) is None
    assert [f["name"] for f in functions_in("def f():\n  pass\nasync def g(): pass")] == ["f"] and functions_in("def") == []
    assert [(d["name"], d["lineno"]) for d in definitions_in("a = b = 1\n(c, d) = 1, 2\ne: int = 3\nclass G:\n  h = 1")] == [("a", 1), ("b", 1), ("e", 3), ("G", 4), ("h", 5)]
    d = dependencies_in("def f():\n  return hidden\nasync def g():\n  return seen\nx.y.z()\nlambda q: w")
    assert "hidden" not in d["names"] and {"seen", "x", "w"} <= set(d["names"])
    assert {(a["base"], a["attr"]) for a in d["attributes"]} == {("x", "y"), ("x.y", "z")}
    assert d["subscripts"] == [] and dependencies_in("a.b[0].c[i]\ndef f():\n  return h[0]")["subscripts"] == ["a.b", "a.b[0].c"]
    assert literal_types("{'a': {'type': 't'}}") == [{"name": "a", "type": "t"}] and literal_types("<x>") is None and literal_types("[1]") == []
    # lines are the tokenizer's: a form feed or a line separator within a line moves no comment
    assert strip_comments("s = 'a\u2028b'  # one\nt = 1  # two") == "s = 'a\nb'\nt = 1"
    assert strip_comments("\x0cx = 1  # one\ny = 2  # two").endswith("x = 1\ny = 2")


def test_type_patterns_find_what_no_literal_holds(spark):
    from verdigris.functions.code import typed_names

    infos = ["{'a': {'type': 'int'}, 'b': {'type': \"<class 'p.Q'>\"}, broken", "{'__method__m': {'type': 'int'}, 'c': {'type': '<lost>'}, broken", "[1, 2]", None, "{'d': {'type': 'str', 'dtype': dtype('int64')}}"]
    df = spark.createDataFrame(list(enumerate(infos)), "i int, info string")
    got = {r.i: [(x.name, x.type) for x in r.t] for r in df.select("i", typed_names(F.col("info")).alias("t")).collect() if r.t is not None}
    assert got[0] == [("a", "int"), ("b", "<class 'p.Q'>")] and got[1] == [] and got[2] == [] and got[4] == [("d", "str")]


def test_grading(spark):
    df = spark.createDataFrame([("a_1_fixed", '{"detection": false}'), ("a_1_fixed", '{"detection": true}'), ("a_1_reproduced", '{"detection": true}'), ("a_1_reproduced", '{"detection": 0}'), ("a_1_fixed", "[Error-skipping]"), ("a_1_fixed", '{"detection": "false"}'), ("a_1_fixed", '{"detection": 0.0}'), ("a_1_fixed", '{"detection": 1.0}'), ("a_1_fixed", '{"detection": 2}'), ("a_1_fixed", '{"detection": null}'), ("a_1_fixed", None)], "i string, r string")
    got = [r.g for r in df.select(grading.grade_detection(F.col("i"), grading.detection_of(F.col("r")), True).alias("g")).collect()]
    assert got == ["correct", "wrong", "check reasoning", "wrong", "cannot verify", "cannot verify", "correct", "wrong", "cannot verify", "cannot verify", "cannot verify"]


def test_aliases(spark):
    names = spark.createDataFrame([("p", "p.core.A", "p.A"), ("p", "q.core.B", "p.B")], "package string, internal string, public string")
    assert aliases.cleaned_map(names).count() == 1
    rows = spark.createDataFrame([("p.core.A",), ("p.A",), ("p.Z",), (None,)], "kind string")
    assert {r.kind: r.public for r in aliases.public_names(rows, names, "kind").collect()} == {"p.core.A": "p.A", "p.A": "p.A", "p.Z": "p.Z", None: None}
    try:
        aliases.public_names(rows, names, "kind", strict=True).collect()
        raise AssertionError
    except Exception as e:
        assert "no public name" in str(e)
    imports = spark.createDataFrame([("torch", "torch"), ("torch.nn", "nn")], "module string, alias string")
    kinds = spark.createDataFrame([(1, "torch.nn.Linear"), (2, "torch.nn"), (3, "torchx.A"), (4, "torch.A")], "i int, kind string")
    assert {r.i: r.matched for r in aliases.longest_prefix(kinds, ["i"], "kind", imports).collect()} == {1: "nn.Linear", 2: "nn", 3: "torchx.A", 4: "torch.A"}


def test_lookup_needs_one_match(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    table = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3")], "k string, v string")
    assert {r.k: r.v for r in summary.looked_up(rows, table, "k", "v").collect()} == {"a": "1", "b": "", "c": ""}
