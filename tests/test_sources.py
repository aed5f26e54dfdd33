import json

import pytest
from pyspark.sql import functions as F

from verdigris.plans import evaluation
from verdigris.sources import jsonlists, readers, runlog, sinks
from verdigris.streaming import runs as streaming_runs
from verdigris.streaming import votes as streaming_votes


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def tree(root):
    write(root / "m1/t1/numpy_1_fixed.json", ["[Correct]", "[Wrong]", "[Correct]"])
    write(root / "m1/t1/numpy_2_reproduced.json", [])
    write(root / "m1/t1/other/torch_1_fixed.json", ["no bracket", {"reasoning": "r", "detection": True}])
    write(root / "m1/t2/numpy_1_fixed.json", ["[Wrong]"])
    write(root / "m1/t1/sub/numpy_9_fixed.json", ["[Wrong]"])


def test_label_tree(spark, tmp_path):
    tree(tmp_path / "labels")
    rows = readers.label_tree(spark, str(tmp_path / "labels")).collect()
    assert sorted({r.instance for r in rows}) == ["numpy_1_fixed", "numpy_2_reproduced", "torch_1_fixed"] and len(rows) == 7
    assert [(r.run, r.label) for r in rows if r.instance == "numpy_2_reproduced"] == [(None, None)]
    assert json.loads(next(r.label for r in rows if r.instance == "torch_1_fixed" and r.run == 1)) == {"reasoning": "r", "detection": True}
    assert {r.instance for r in readers.label_tree(spark, str(tmp_path / "labels"), ["numpy", "sub"]).collect()} == {"numpy_1_fixed", "numpy_2_reproduced", "numpy_9_fixed"}
    wide = {r.instance: r.asDict() for r in evaluation.vote_summary(readers.label_tree(spark, str(tmp_path / "labels")), ["m1_t1", "m1_t2"]).collect()}
    assert wide["numpy_1_fixed"]["m1_t1"] == "correct" and wide["numpy_1_fixed"]["m1_t2"] == "wrong"
    # an empty file votes with an empty text, an absent one not at all
    assert wide["numpy_2_reproduced"]["m1_t1"] == "" and wide["numpy_2_reproduced"]["m1_t2"] is None


def test_analyzer_tree(spark, tmp_path):
    write(tmp_path / "a/pylint/t1/numpy/numpy_1_fixed.json", ["x"])
    write(tmp_path / "a/pylint/t1/other/torch_1_fixed.json", ["x"])
    assert [r.instance for r in readers.analyzer_tree(spark, str(tmp_path / "a"), ["numpy"]).collect()] == ["numpy_1_fixed"]
    write(tmp_path / "a/pylint/t1/numpy/numpy_1_reproduced.json", [])
    write(tmp_path / "a/pylint/t1/numpy/numpy_2_fixed.json", [])
    write(tmp_path / "a/pylint/t1/numpy/broken.json", "no list")
    found = readers.analyzer_findings(spark, str(tmp_path / "a"), ["numpy"])
    assert {r.instance: r.pylint_t1 for r in evaluation.analyzer_summary(found, ["pylint_t1"]).collect()} == {"numpy_1_fixed": "wrong", "numpy_1_reproduced": "wrong", "numpy_2_fixed": "correct"}
    assert {r.instance: r.label for r in readers.analyzer_tree(spark, str(tmp_path / "a"), ["numpy"]).collect()} == {"numpy_1_fixed": "x", "numpy_1_reproduced": None, "numpy_2_fixed": None}


def test_notebooks_aliases_rules(spark, tmp_path):
    cells = [{"cell_type": "markdown", "source": "t"}, {"cell_type": "code", "execution_count": 2, "source": ["a\n", "b"], "outputs": []}, {"cell_type": "code", "execution_count": None, "source": "c", "outputs": [{"output_type": "error", "traceback": ["x", "y"]}]}]
    write(tmp_path / "n/numpy_1.ipynb", {"cells": cells})
    got = [tuple(r) for r in readers.notebook_cells(spark, str(tmp_path / "n")).orderBy("code_cell_id").collect()]
    assert got == [("numpy_1", 0, 2, "a\nb", False, None), ("numpy_1", 1, None, "c", True, "x\ny")]
    write(tmp_path / "map.json", {"p": {"p.a": "p.A"}})
    assert [tuple(r) for r in readers.alias_map(spark, str(tmp_path / "map.json")).collect()] == [("p", "p.a", "p.A")]
    write(tmp_path / "rules.json", {"enabled_rules": ["z", "a"]})
    assert readers.enabled_rules(spark, str(tmp_path / "rules.json")) == ["a", "z"]
    names = spark.createDataFrame([("numpy_1",), ("numpy_x",), ("n1_2",)], "name string")
    assert [r.name for r in readers.cases(names).collect()] == ["numpy_1"]


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 0, "y"), ("b", 0, "z")], "k string, pos int, v string")
    sinks.write_json_lists(t, ["k"], "v", "pos", str(tmp_path / "j"))
    assert {r.k: r["items"] for r in spark.read.json(str(tmp_path / "j")).collect()} == {"a": ["y", "x"], "b": ["z"]}
    sinks.write_table(t, str(tmp_path / "c"), "csv")
    sinks.write_table(t, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 3
    sinks.write_texts(spark.createDataFrame([("i", "one\ntwo"), ("j", "three\n\n"), ("k", "")], "k string, t string"), "k", "t", str(tmp_path / "t"))
    assert sorted(r.value for r in readers.whole_texts(spark, str(tmp_path / "t"), "*.txt").collect()) == ["\n", "one\ntwo\n", "three\n\n"]
    sinks.write_missing(t.select("k", "v"), spark.createDataFrame([("a",)], "k string"), "k", str(tmp_path / "w"))
    assert [r.k for r in spark.read.parquet(str(tmp_path / "w")).collect()] == ["b"]


def test_runs_are_appended_instance_by_instance(spark, tmp_path):
    """Any order of batches and retries gives the lists that appending to one list for each instance gives."""
    path, want = str(tmp_path / "log"), {}
    kinds = "instance string, model string, task string, value string, at int"
    batches = {"1": [("A", "m", "t", "a0", 0)], "2": [("B", "m", "t", "b0", 0)], "2024-01-01": [("A", "m", "t", "a1", 0), ("A", "m", "u", "x", 0), (None, "m", "t", "n0", 0)], "4": [("A", "m", "t", "a3", 2), ("A", "m", "t", "a2", 1), (None, "m", "t", "n1", 0)]}
    assert runlog.read_runs(spark, path) is None and runlog.commits(spark, path) is None
    for k, (token, rows) in enumerate(batches.items()):
        values = spark.createDataFrame(rows, kinds)
        # a batch that broke off before its commit leaves rows that nobody sees
        values.limit(0 if k % 2 else 1).selectExpr("*", "7L AS run").write.parquet(f"{path}/batches/token=b.{token}")
        assert k == 0 or {tuple(r)[:3]: list(r["items"]) for r in runlog.lists(runlog.read_runs(spark, path)).collect()} == want
        assert runlog.append_runs(values, path, token, "at") is True
        assert runlog.append_runs(values, path, token, "at") is False  # tried again
        for *key, value, _ in sorted(rows, key=lambda r: r[4]):
            want.setdefault(tuple(key), []).append(value)
        if k == 2:
            assert runlog.compact(spark, path, "c") and not runlog.compact(spark, path, "c")
    read = lambda: {tuple(r)[:3]: list(r["items"]) for r in runlog.lists(runlog.read_runs(spark, path)).collect()}
    assert read() == want and want[("A", "m", "t")] == ["a0", "a1", "a2", "a3"]
    assert [(r.token, r.rows) for r in runlog.commits(spark, path).orderBy("batch").collect()] == [("c", 5), ("4", 3)]
    assert runlog.vacuum(spark, path) == ["1", "2", "2024-01-01"] and read() == want
    assert runlog.append_runs(spark.createDataFrame(batches["1"], kinds), path, "1", "at") is False  # still known
    with pytest.raises(ValueError, match="folder"):
        runlog.append_runs(spark.createDataFrame(batches["1"], kinds), path, "a/b")


def test_trees_below_any_root(spark, tmp_path):
    for root in ("out/runs/out", "m1/t1/m1", "a b+c%20[x]{y,z}/t*"):
        tree(tmp_path / root)
        write(tmp_path / root / "m 1+%/t1/other/torch_9_fixed.json", ["x"])
        got = readers.label_tree(spark, str(tmp_path / root)).collect()
        assert {(r.model, r.task, r.instance) for r in got} == {("m1", "t1", "numpy_1_fixed"), ("m1", "t1", "numpy_2_reproduced"), ("m1", "t1", "torch_1_fixed"), ("m1", "t2", "numpy_1_fixed"), ("m 1+%", "t1", "torch_9_fixed")}
        assert [(r.model, r.library, r.instance) for r in readers.analyzer_tree(spark, str(tmp_path / root) + "/", ["sub"]).collect()] == [("m1", "sub", "numpy_9_fixed")]
    (tmp_path / "none").mkdir()
    assert readers.label_tree(spark, str(tmp_path / "none")).collect() == []


def test_json_lists_by_file(spark, tmp_path):
    """Byte for byte what Python's own indented form of each list is."""
    want = {"m/t/a_1": ["[Wrong]", "é \"q\"\n\ttab", "", "null", None], "m/t/empty": [], "m 2/a+b%": ["z"] * 3}
    rows = [(f, k, v) for f, vs in want.items() for k, v in enumerate(vs)] + [("m/t/empty", None, None), (None, 0, "lost")]
    df = spark.createDataFrame(rows, "f string, pos int, v string").repartition(5)
    for _ in range(2):
        jsonlists.write_json_lists(df, F.col("f"), "pos", "v", str(tmp_path / "out"))
    got = {str(p.relative_to(tmp_path / "out")): p.read_text("utf-8") for p in (tmp_path / "out").rglob("*.json")}
    assert got == {f"{f}.json": json.dumps(vs, indent=2, ensure_ascii=False) for f, vs in want.items()} and [p.name for p in tmp_path.iterdir()] == ["out"]
    objects = [{"reasoning": "é", "detection": True, "n": [1, {"x": None}], "e": {}, "l": []}, "raw", 1.5]
    given = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(objects)], "pos int, v string").withColumn("more", F.parse_json("v"))
    jsonlists.write_json_lists(given, F.lit("x"), "pos", "v", str(tmp_path / "objects"), ascii=True, as_json=True)
    assert (tmp_path / "objects/x.json").read_text() == json.dumps(objects, indent=2)
    jsonlists.write_json_lists(given, F.lit("x"), "pos", "more", str(tmp_path / "variants"))
    assert json.loads((tmp_path / "variants/x.json").read_text("utf-8")) == objects
    assert {(r.pos, r.kind) for r in jsonlists.mixed_lists(spark, str(tmp_path / "objects")).collect()} == {(0, "object"), (1, "string"), (2, "number")}
    with pytest.raises(Exception, match="(?s)JSON|json|Expecting"):
        jsonlists.write_json_lists(df, F.col("f"), "pos", "v", str(tmp_path / "out"), as_json=True)
    assert len(list((tmp_path / "out").rglob("*.json"))) == 3 and sorted(p.name for p in tmp_path.iterdir()) == ["objects", "out", "variants"]


def test_a_very_long_json_list(spark, tmp_path):
    """One key of 300,000 items goes through a task item by item."""
    jsonlists.write_json_lists(spark.range(300_000).selectExpr("id", "'x' AS v"), F.lit("long"), "id", "v", str(tmp_path / "out"))
    assert (tmp_path / "out/long.json").read_text() == json.dumps(["x"] * 300_000, indent=2)


def test_mixed_items_of_odd_texts(spark):
    df = spark.createDataFrame([("a", "[]"), ("b", "{\"x\": 1}"), ("c", "no json"), ("d", None), ("e", "[\"[1]\", {\"detection\": 0}]")], "value string, text string")
    got = jsonlists.items_of(df, "text").select("value", "pos", jsonlists.kind_of(F.col("item")).alias("kind"), jsonlists.raw_text(F.col("item")).alias("raw"), jsonlists.boolean_field(F.col("item"), "detection").alias("d"))
    assert sorted(map(tuple, got.collect())) == [("e", 0, "string", "[1]", None), ("e", 1, "object", None, None)]


def test_notebook_sources(spark, tmp_path):
    sources = ["[1, 2, 3]", '["a", "b"]', ["[1,\n", " 2]"], "", [], "{}", '"quoted"', "1"]
    write(tmp_path / "n/x_1.ipynb", {"cells": [{"cell_type": "code", "execution_count": None, "source": s, "outputs": []} for s in sources]})
    got = [r.code for r in readers.notebook_cells(spark, str(tmp_path / "n")).orderBy("code_cell_id").collect()]
    assert got == [s if isinstance(s, str) else "".join(s) for s in sources]


def test_streamed_votes(spark, tmp_path):
    labels = "cell string, label string, pos long"
    spark.createDataFrame([("a", "x", 0), ("a", "y", 1)], labels).write.parquet(str(tmp_path / "in"), mode="append")
    spark.createDataFrame([("a", "y", 2), ("b", "z", 0)], labels).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(labels).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    write_on = lambda: streaming_votes.write_counts(stream, ["cell"], "label", "pos", out, str(tmp_path / "cp"), available_now=True)
    votes = lambda path=out: {r.cell: (r.vote, r.n_votes) for r in streaming_votes.current_votes(spark, path, ["cell"], "label").collect()}
    write_on()
    assert votes() == {"a": ("y", 2), "b": ("z", 1)}
    spark.createDataFrame([("a", "x", 3), ("b", "w", 1)], labels).write.parquet(str(tmp_path / "in"), mode="append")
    write_on()
    # ties go to the first seen; the second batch holds changed cells alone
    assert votes() == {"a": ("x", 2), "b": ("z", 1)}
    assert spark.read.parquet(out).where("batch = (select max(batch) from parquet.`%s`)" % out).count() == 2
    streaming_votes.compact(spark, out, str(tmp_path / "compact"), ["cell"], "label")
    assert votes(str(tmp_path / "compact")) == votes()


def test_votes_of_runs_that_come_again_and_late(spark, tmp_path):
    """After each batch the stream's votes are those of all rows so far in one batch, each run counted once."""
    kinds = "cell string, model string, run long, label string"
    batches = [
        [("a", "m", 5, "x"), ("a", "m", 6, "y"), ("b", "m", 1, "z"), (None, "m", 1, "n")], [("a", "m", 5, "x")] * 3 + [("b", "m", None, "w"), ("b", "m", 2, None)],
        [("a", "m", 1, "y"), ("b", "m", 0, "w"), ("b", "n", 0, "w")], [("a", "m", 1, "y"), ("a", "m", 0, "x"), ("b", "m", 1, "z")], [("a", "m", 9, "x"), ("a", "m", 6, "y")],
    ]
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, streaming_runs.STATE_STORE)
    try:
        (tmp_path / "in").mkdir()
        stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
        now = {}

        def keep(df, _):
            now.update({(r.cell, r.model): (r.vote, r.n_votes) for r in df.collect()})

        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "in"), mode="append")
            votes = streaming_runs.votes_of_runs(stream, ["cell", "model"], "label", "run")
            votes.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
            so_far = spark.createDataFrame([r for b in batches[: k + 1] for r in b], kinds)
            assert now == {(r.cell, r.model): (r.vote, r.n_votes) for r in streaming_runs.votes_of_batch(so_far, ["cell", "model"], "label", "run").collect()}
        assert now == {("a", "m"): ("x", 3), ("b", "m"): ("w", 1), ("b", "n"): ("w", 1), (None, "m"): ("n", 1)}
        # runs that are remembered for a time: such a stream never runs out of batches
        now.clear()
        votes = streaming_runs.votes_of_runs(stream, ["cell", "model"], "label", "run", seen_ms=3_600_000)
        q = votes.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).foreachBatch(keep).start()
        for _ in range(60):
            if len(now) == 4 or q.exception():
                break
            q.awaitTermination(1)
        q.stop()
        assert now[("a", "m")] == ("x", 3) and len(now) == 4
    finally:
        spark.conf.set(key, before)


def test_final_statistics(spark):
    human = spark.createDataFrame([("n_1_fixed", "correct", "wrong"), ("n_1_reproduced", "wrong", None)], "instance string, m_code string, m_info string")
    llm = spark.createDataFrame([("n_1_fixed", "correct", "correct"), ("n_1_reproduced", "correct", "correct")], "instance string, m_code string, m_info string")
    got = {r.variant: (r.n, r.mismatches, r.accuracy) for r in evaluation.judge_accuracy(human, llm, None, [("m", "code", "m_code_human", "m_code_llm"), ("m", "info", "m_info_human", "m_info_llm")]).collect()}
    assert got == {"code": (2, 1, 0.5), "info": (1, 1, 0.0)}
    causes = spark.createDataFrame([("n_1", None)], "instance string, `Libs-cause` string")
    rates = evaluation.rates(human.union(human).union(human), causes, "Libs-cause", [("m", "m_info", "m_code")], support=3).collect()
    assert [(r.model, r.cause, r.n, r.with_rate, r.without_rate) for r in rates] == [("m", "NBspecific", 3, 0.0, 0.0)]
