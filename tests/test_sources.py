import json

import pytest
from pyspark.sql import functions as F

from chatprep.operators import templates as R
from chatprep.sources import features as FE
from chatprep.sources import files as FI
from chatprep.sources import jsonl as J
from chatprep.sources import normalise as N
from chatprep.sources import registry as G
from chatprep.sources import results as RS
from chatprep.sources import vocabulary as VO

LINES = [
    "",
    "   ",
    '{"conversations": [{"role": "user", "content": "hi"}',
    '[1, 2]',
    '{"conversations": "text"}',
    '{"id": 7, "conversations": null}',
    '{"text": "ready"}',
    '{"conversations": [["user", "hi"], {"role": "user", "content": {"a": [1]}}, 3], "tools": null}',
    '{"conversations": [{"role": "user", "content": "é"}], "tools": "[{\\"n\\": 1}]"}',
    '{"conversations": [], "tools": "broken"}',
    '{"conversations": [], "tools": [{"n": {"m": null}}]}',
    '{"conversations": [{"role": "assistant", "content": null, "tool_calls": [{"id": "1"}], "extra": 1}]}',
]


@pytest.fixture(scope="module")
def parsed(spark):
    return J.parse_lines(spark.createDataFrame([(x,) for x in LINES], "value string")).cache()


def test_lenient_scan(parsed):
    rows = [r.asDict(recursive=True) for r in J.good_lines(parsed).collect()]
    assert len(rows) == 7
    by = lambda i: rows[i]
    assert by(0)["id"] == "7" and by(0)["conversations"] == []
    assert by(1)["text"] == "ready" and by(1)["conversations"] == [] and by(1)["tools"] is None
    message = by(2)["conversations"]
    assert len(message) == 1 and json.loads(message[0]["content"]) == {"a": [1]} and by(2)["tools"] == "[]"
    assert by(3)["conversations"][0]["content"] == "é" and json.loads(by(3)["tools"]) == [{"n": 1}]
    assert by(4)["tools"] == "broken"
    assert json.loads(by(5)["tools"]) == [{"n": {"m": None}}]
    assert by(6)["conversations"][0]["content"] is None
    assert json.loads(by(6)["conversations"][0]["tool_calls"]) == [{"id": "1"}]


def test_quarantine(parsed):
    reasons = sorted(r.reason for r in J.quarantine(parsed).collect())
    assert reasons == ["conversations is not a list", "not JSON", "not an object"]


def test_tool_calls(spark):
    cases = [
        '[{"id": "c1", "function": {"name": "f", "arguments": "{\\"x\\": 1}"}, "junk": 2}, 5]',
        '[{"type": "t", "function": {"arguments": "{broken"}}]',
        '[{"function": {"name": "g", "arguments": {"y": [1]}}}, {"function": "odd"}]',
        "not json",
        None,
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = {r.i: r.t for r in df.select("i", J.clean_tool_calls(F.col("c")).alias("t")).collect()}
    (one,) = got[0]
    assert (one.id, one.type, one.function.name, json.loads(one.function.arguments)) == ("c1", "function", "f", {"x": 1})
    (two,) = got[1]
    assert (two.id, two.type, two.function.name, two.function.arguments) == ("", "t", "", "{}")
    assert json.loads(got[2][0].function.arguments) == {"y": [1]} and got[2][1].function is None
    assert got[3] is None and got[4] is None


def test_sanitised_messages(spark):
    kind = "array<struct<role:string,content:string,tool_calls:string,reasoning_content:string,extra:string>>"
    df = spark.createDataFrame([([("assistant", "a", "[]", "why", "x")],)], f"c {kind}")
    plain, thinking = df.select(
        J.sanitise_messages(F.col("c")).alias("a"), J.sanitise_messages(F.col("c"), True).alias("b")
    ).first()
    assert plain[0].asDict() == {"role": "assistant", "content": "a", "tool_calls": []}
    assert thinking[0].reasoning_content == "why" and "extra" not in thinking[0].asDict()


def test_tools(spark):
    df = spark.createDataFrame([("[1]",), ("{}",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(F.to_json(J.parse_tools(F.col("t")))).collect()] == ["[1]", "[]", "[]", "[]"]


def test_render_options(spark):
    df = spark.createDataFrame([("a", None), ("b", 2)], "x string, y int")
    rows = J.render_options(df, ["x", "y"]).collect()
    assert [r.render_options for r in rows] == [{"x": "a"}, {"x": "b", "y": "2"}]


def test_suffix_dispatch(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi",\nthen go')], "id string, text string")
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "a.csv"))
    df.write.json(str(tmp_path / "a.jsonl"))
    df.write.parquet(str(tmp_path / "a.parquet"))
    for suffix in ("csv", "jsonl", "parquet"):
        row = FI.load_by_suffix(spark, str(tmp_path / f"a.{suffix}")).first()
        assert row.text == 'say "hi",\nthen go', suffix
    with pytest.raises(ValueError):
        FI.load_by_suffix(spark, "data.xyz")


def test_train_test_sink(spark, tmp_path):
    a = spark.createDataFrame([("é",)], "x string")
    path = str(tmp_path / "out")
    assert FI.write_train_test(a, a, path, "d")
    assert not FI.write_train_test(a, a, path, "d")
    text = spark.read.text(f"{path}/d_train.jsonl").first().value
    assert text == '{"x":"é"}'
    assert spark.read.json(f"{path}/d_test.jsonl").count() == 1
    assert FI.write_jsonl(a, f"{path}/one") and not FI.write_jsonl(a, f"{path}/one")


def test_keyed_stage(spark, tmp_path):
    calls = {"length": 5, "template": "qwen"}
    first = FI.keyed_stage(spark.range(3), str(tmp_path), calls)
    again = FI.keyed_stage(spark.range(9), str(tmp_path), calls)
    other = FI.keyed_stage(spark.range(9), str(tmp_path), {**calls, "last_only": True})
    assert (first.count(), again.count(), other.count()) == (3, 3, 9)
    assert FI.stage_key(a=1, b=2) == FI.stage_key(b=2, a=1) != FI.stage_key(a=1, b=3)


def test_status_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "success"), (2, "error"), (3, "success")], "id int, status string")
    FI.write_by_status(df, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o/status=success")).count() == 2
    assert spark.read.json(str(tmp_path / "o/status=error")).count() == 1


def test_feature_store(spark, tmp_path):
    rows = [(str(i), [1, 2], [0, 1], [float("nan") if i == 3 else 0.5], [0.1]) for i in range(10)]
    schema = "id string, input_ids array<int>, loss_mask array<int>, hidden_state array<float>, aux_hidden_state array<float>"
    df = spark.createDataFrame(rows, schema).withColumn("row", F.col("id").cast("int"))
    path = str(tmp_path / "store")
    FE.write_features(FE.cluster(df.filter("row < 5"), group_size=4), path, group_size=4)
    kept = FE.read_store(spark, path)
    assert kept.count() == 4 and {r.bucket for r in kept.collect()} == {0, 4}
    assert [(r.rows, r.rejected) for r in FE.writes(spark, path).collect()] == [(5, 1)]
    assert FE.broken_files(spark, path).count() == FE.changed_files(spark, path).count() == 0
    files = sorted((tmp_path / "store").rglob("bucket=*/*.parquet"), key=str)
    # An aborted write left a file; a committed one was cut; another holds other rows of the same size.
    aborted = tmp_path / "store" / "write=aborted" / "bucket=0"
    aborted.mkdir(parents=True)
    (aborted / "x.parquet").write_bytes(files[0].read_bytes())
    assert FE.read_store(spark, path).count() == 4 and FE.broken_files(spark, path).count() == 0
    whole = files[0].read_bytes()
    files[0].write_bytes(whole[: len(whole) // 2])
    for f in (tmp_path / "store").rglob(".*.crc"):
        f.unlink()
    (broken,) = FE.broken_files(spark, path).collect()
    assert broken.problem == "size" and broken.file.endswith(files[0].name) and broken.rows == 3
    assert {(r.file.split("/")[-1], r.rows_read) for r in FE.changed_files(spark, path).collect()} == {(files[0].name, 0)}
    files[0].unlink()
    (broken,) = FE.broken_files(spark, path).collect()
    assert broken.problem == "missing"


def test_features_without_a_manifest(spark, tmp_path):
    path, schema = str(tmp_path / "plain"), "id string, row int"
    spark.range(4).selectExpr("cast(id as string) id", "cast(id as int) row").coalesce(1).write.parquet(path)
    (tmp_path / "plain" / "broken.parquet").write_bytes(b"junk")
    with pytest.raises(Exception, match="broken.parquet"):
        FE.read_features(spark, path, schema).collect()
    assert FE.read_features(spark, path, schema, tolerant=True).count() == 4
    (broken,) = FE.unreadable_files(spark, path, schema).collect()
    assert broken.path.endswith("broken.parquet") and (broken.rows, broken.rows_read) == (None, 0)


def test_arrays_stay_in_their_task(spark, tmp_path):
    """Samples and stored keys meet without a shuffle, and nothing is shuffled once the arrays exist."""
    samples = spark.range(3000).selectExpr("cast(id AS string) AS id", "id AS row")
    table = FE.save_bucketed(samples, str(tmp_path / "samples"), "id")
    FE.save_bucketed(samples.limit(5).selectExpr("id AS key", "'w' AS write"), str(tmp_path / "store.keys"), "key")
    spark.createDataFrame([("w", 5, 0)], "write string, rows bigint, rejected bigint").write.parquet(str(tmp_path / "store.writes"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo = FE.not_stored(table, FE.stored_keys(spark, str(tmp_path / "store")))
        plan = todo._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        made = FE.compute_features(FE.cluster(todo), lambda df: df, "id string, row bigint")
        lines = made._jdf.queryExecution().executedPlan().toString().split("\n")
        (arrays,) = [i for i, line in enumerate(lines) if "MapInPandas" in line]
        exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
        assert len(exchanges) == 1 and exchanges[0] > arrays
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_half_broken_feature_file(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.range(50_000).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("x"))
    df.coalesce(1).write.option("parquet.block.size", 256 << 10).option("compression", "snappy").parquet(path)
    (file,) = (tmp_path / "store").glob("*.parquet")
    raw = bytearray(file.read_bytes())
    middle = len(raw) // 2
    raw[middle : middle + 200_000] = b"\xff" * 200_000
    file.write_bytes(raw)
    (tmp_path / "store" / f".{file.name}.crc").unlink(missing_ok=True)
    (found,) = FE.unreadable_files(spark, path, "id string, x string").collect()
    assert found.rows == 50_000 and found.rows_read < 50_000
    with pytest.raises(Exception):
        FE.read_features(spark, path, "id string, x string").select(F.max("x")).collect()


def test_feature_resume(spark, tmp_path):
    schema = "id string, row int, input_ids array<int>, loss_mask array<int>, hidden_state array<float>, aux_hidden_state array<float>"
    samples = spark.range(6).selectExpr("cast(id as string) id", "cast(id as int) row")

    def model(batch):
        n = len(batch)
        return batch.assign(input_ids=[[1]] * n, loss_mask=[[1]] * n, hidden_state=[[0.5]] * n, aux_hidden_state=[[0.5]] * n)

    path = str(tmp_path / "f")
    FE.resume(samples.filter("row < 2"), path, model, schema)
    FE.resume(samples, path, model, schema)
    ids = [r.id for r in spark.read.parquet(path).collect()]
    assert sorted(ids) == [str(i) for i in range(6)]


def test_vocabulary_store(spark, tmp_path):
    top = spark.createDataFrame([(3,), (9,), (5,)], "token_id int")
    path = str(tmp_path / "v")
    assert VO.save_mapping(top, 12, path) and not VO.save_mapping(top, 12, path)
    d2t, t2d = VO.load_mapping(spark, path)
    assert [tuple(r) for r in d2t.orderBy("draft_id").collect()] == [(0, 3, 3), (1, 5, 4), (2, 9, 7)]
    assert {r.token_id for r in t2d.filter("in_draft").collect()} == {3, 5, 9} and t2d.count() == 12


def test_result_documents(spark, tmp_path):
    kind = "model string, bench string, batch_size int, steps int, topk int, num_draft_tokens int, num_samples int, metrics array<struct<latency:double>>"
    rows = [("m", "b", 4, 3, 1, 4, 10, [(1.5,)]), ("m", "b", 1, 0, 0, 0, 10, [(2.0,)]), ("m", "a", 1, 0, 0, 0, None, [])]
    df = spark.createDataFrame(rows, kind)
    document = json.loads(RS.result_documents(df).first().value)
    assert document["model"] == "m" and [r["batch_size"] for r in document["benchmarks"]["b"]] == [1, 4]
    target = RS.write_results(df, str(tmp_path), "x")
    assert spark.read.text(target).count() == 1


def test_metric_log(spark, tmp_path):
    df = spark.createDataFrame([("r", 1, "train", 0, "acc", 0.5)], "run string, step bigint, mode string, position int, metric string, value double")
    for _ in range(2):
        RS.log_metrics(df, str(tmp_path / "m"))
    assert RS.read_metrics(spark, str(tmp_path / "m")).count() == 2


def test_last_checkpoint(spark):
    names = ["a/epoch_2", "a/epoch_10_step_5", "a/epoch_10_step_40", "a/epoch_x", "a/other_99"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert tuple(RS.last_checkpoint(df).first()) == ("a/epoch_10_step_40", 10, 40)
    assert tuple(RS.last_checkpoint(df.filter("path = 'a/other_99'")).first()) == (None, 0, 0)


def test_strict_roles_fail(spark):
    df = spark.createDataFrame([("1", [("tool", "x")])], "prompt_id string, messages array<struct<role:string,content:string>>")
    with pytest.raises(Exception, match="unexpected role"):
        N.messages_strict(df).collect()


def test_image_conversation(spark):
    conv = "c array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("assistant", "skip"), ("user", "look"), ("assistant", "ok")],)], conv)
    (out,) = df.select(N.image_conversation(F.col("c"), F.lit("p.png"), "sys")).first()
    assert [m.role for m in out] == ["system", "user", "assistant"]
    assert [(p.type, p.text, p.image) for p in out[1].content] == [("image", None, "p.png"), ("text", "look", None)]
    bad = spark.createDataFrame([([("user", "a"), ("user", "b")],)], conv)
    with pytest.raises(Exception, match="unexpected role"):
        bad.select(N.image_conversation(F.col("c"), F.lit("p"), "s")).collect()


def test_image_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.png").write_bytes(b"x")
    files = FI.image_files(spark, str(tmp_path))
    assert [r.path for r in files.collect()] == ["d/a.png"]
    chat = "array<struct<from:string,value:string>>"
    rows = spark.createDataFrame([("1", "d/a.png", []), ("2", "d/b.png", [])], f"id string, image string, conversations {chat}")
    assert [(r.id, r.image) for r in N.with_image(rows, images=files, root="s3://b/x").collect()] == [("1", "s3://b/x/d/a.png")]


def test_registries(spark, tmp_path):
    assert len(G.source_names()) == 20 and len(R.template_names()) == 22
    assert R.templates_table(spark).count() == 22
    with pytest.raises(ValueError):
        R.register_template("qwen")
    with pytest.raises(ValueError):
        R.get_template("none")
    old = R.get_template("qwen")
    R.register_template("qwen", override=True, assistant_header="x")
    assert R.get_template("qwen").assistant_header == "x"
    R._REGISTRY["qwen"] = old
    with pytest.raises(ValueError):
        G.get_source("none")
    for name in ("biology", "chemistry", "physics"):
        spark.createDataFrame([(name, "a")], "message_1 string, message_2 string").write.parquet(str(tmp_path / f"{name}.parquet"))
    path = str(tmp_path) + "/{subset}.parquet"
    assert G.read_source(spark, "camel", path).count() == 3
    assert G.read_source(spark, "camel", path, "physics").count() == 1
    with pytest.raises(ValueError):
        G.read_source(spark, "camel", path, "law")


def test_missing_subsets(spark, tmp_path):
    def load(name):
        if name == "gone":
            return spark.read.parquet(str(tmp_path / "gone"))
        if name == "odd":
            raise OSError(name)
        return spark.range(2)

    with pytest.warns(UserWarning, match="gone"):
        assert G.load_subsets(load, ["a", "gone"], skip_missing=True).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        G.load_subsets(load, ["a", "gone"])
    with pytest.raises(OSError):
        G.load_subsets(load, ["a", "odd"], skip_missing=True)
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        G.load_subsets(load, ["gone"], skip_missing=True)
