"""Saved datasets, detectors as table functions, and runs that are checked first and counted as they write."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilmark.operators import runs, table_functions
from veilmark.plans import derived
from veilmark.sources import saved
from veilmark.sources.policy import load_policy, parse_policy


def test_saved_dataset_round_trip(spark, tmp_path):
    rows = [(i, f"text {i}" if i % 3 else None, [(1, 2, "x")] if i % 2 else []) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string, spans array<struct<start:int,end:int,label:string>>").repartition(4)
    saved.write_saved(df, str(tmp_path / "one"))
    back = saved.read_saved(spark, str(tmp_path / "one"))
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    state = json.loads((tmp_path / "one" / "state.json").read_text())
    assert back.rdd.getNumPartitions() == len(state["_data_files"]) > 1
    two = saved.read_saved(spark, str(tmp_path / "one"), columns=["spans", "id"])
    assert two.columns == ["spans", "id"] and two.where("id = 7").first()["spans"][0]["end"] == 2
    first = saved.fingerprint(str(tmp_path / "one"))
    saved.write_saved(df.limit(3), str(tmp_path / "one"), overwrite=False)
    assert saved.read_saved(spark, str(tmp_path / "one")).count() == 53 and saved.fingerprint(str(tmp_path / "one")) != first
    (tmp_path / "one" / "data-lost.arrow").write_bytes(b"left by a lost task")
    assert saved.read_saved(spark, str(tmp_path / "one")).count() == 53
    with pytest.raises(Exception, match="no columns"):
        saved.read_saved(spark, str(tmp_path / "one"), columns=["none"])
    saved.write_saved(df.where("false"), str(tmp_path / "empty"))
    assert saved.read_saved(spark, str(tmp_path / "empty")).count() == 0


def test_folder_that_another_library_saved(spark, tmp_path):
    """Two files and large strings, as other writers make them."""
    folder = tmp_path / "set" / "validation"
    folder.mkdir(parents=True)
    for k in range(2):
        batch = pa.record_batch([pa.array([f"t{k}", None], pa.large_string()), pa.array([k, k + 10], pa.int32())], names=["source_text", "uid"])
        with pa.OSFile(str(folder / f"data-{k:05d}-of-00002.arrow"), "wb") as sink, pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
            out.write_batch(batch)
    (folder / "state.json").write_text(json.dumps({"_data_files": [{"filename": f"data-{k:05d}-of-00002.arrow"} for k in range(2)], "_fingerprint": "abc"}))
    (tmp_path / "set" / "dataset_dict.json").write_text(json.dumps({"splits": ["validation"]}))
    got = saved.read_saved(spark, str(tmp_path / "set"), "validation")
    assert sorted(map(tuple, got.na.fill("-").collect())) == sorted([("t0", 0), ("-", 10), ("t1", 1), ("-", 11)] * 2)
    assert saved.fingerprint(str(tmp_path / "set")) == "abc"
    with pytest.raises(ValueError, match="no split"):
        saved.split_folder(str(tmp_path / "set"), "train")
    with pytest.raises(Exception, match="no saved dataset"):
        saved.read_saved(spark, str(tmp_path), columns=["x"]).count()


def test_table_functions(spark):
    with pytest.raises(ValueError, match="built-in"):
        table_functions.register_kind("regex", derived._word_list)
    table_functions.register_kind("word_list", derived._word_list)
    import yaml

    policy = parse_policy(yaml.safe_load(derived._WORD_POLICY))
    df = spark.createDataFrame([(1, "The cat and die Katze"), (2, None), (3, "none"), (4, "the the the.")], "i int, text string")
    got = table_functions.function_spans(df, policy.detectors["names"]).orderBy("i", "start").collect()
    assert [(r["i"], r["start"], r["end"], r["label"], r["detector"], r["canonical"]) for r in got] == [
        (1, 0, 3, "ORGANIZATION", "names:ORGANIZATION", "organization"), (1, 12, 15, "ORGANIZATION", "names:ORGANIZATION", "organization"),
        (4, 0, 3, "ORGANIZATION", "names:ORGANIZATION", "organization"), (4, 4, 7, "ORGANIZATION", "names:ORGANIZATION", "organization"),
    ]
    rows, extra = table_functions.with_function_spans(df, policy, "i")
    assert {r["i"]: len(r["x"]) for r in rows.select("i", extra.alias("x")).collect()} == {1: 2, 2: 0, 3: 0, 4: 2}
    with pytest.raises(ValueError, match="unknown type"):
        parse_policy(yaml.safe_load(derived._WORD_POLICY.replace("word_list", "no_such_kind")))


def test_runs_are_checked_before_they_start(spark):
    policy = load_policy()
    assert "email" not in runs.ensure_ready(spark, policy) and "ru_pii_regex" in runs.ensure_ready(spark, policy)
    good = lambda: lambda texts: [[(0, 1, "x", 0.5)] for _ in texts]
    assert "pii_token_classifier" in runs.ensure_ready(spark, policy, loaders={"pii_token_classifier": good})
    for bad in (lambda: lambda texts: [], lambda: lambda texts: [[(5, 2, "x", 0.5)]], lambda: lambda texts: 1 / 0, lambda: lambda texts: [[(0, 10_000, "x", 0.5)]]):
        with pytest.raises(runs.NotReady):
            runs.ensure_ready(spark, policy, loaders={"pii_token_classifier": bad})
    with pytest.raises(runs.NotReady, match="without a detector"):
        runs.ensure_ready(spark, policy, loaders={"nothing": good})
    broken = parse_policy({"default_policy": "a", "policies": {"a": {"analyzer_profile": "p"}}, "analyzer_profiles": {"p": {"analysis": {"recognizers": ["r"]}}}, "recognizer_definitions": {"r": {"type": "regex", "params": {"patterns": [{"name": "n", "label": "X", "pattern": "(a"}]}}}})
    with pytest.raises(runs.NotReady, match="no expression"):
        runs.ensure_ready(spark, broken)


def test_counts_come_from_the_run_itself(spark, tmp_path):
    df = spark.createDataFrame([("write to a@b.example now",), ("nothing here",), ("10.0.0.1 and c@d.example",)], "text string").coalesce(1)
    report = runs.run_detection(df, load_policy(), lambda found: found.select("spans").write.parquet(str(tmp_path / "o")))
    assert (report["rows"], report["spans"], report["characters"]) == (3, 3, 60) and report["detectors"] == {"ru_pii_regex:EMAIL_ADDRESS": 2, "ip_address_lib": 1}
    assert spark.read.parquet(str(tmp_path / "o")).select(F.sum(F.size("spans"))).first()[0] == 3 and report["elapsed_seconds"] > 0
