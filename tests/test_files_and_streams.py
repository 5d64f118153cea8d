"""Sources, sinks and streaming forms: round trips, and streams against their batch twins."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomtrace.functions.text import tokens
from loomtrace.operators import retrieval
from loomtrace.sources import files
from loomtrace.streaming import folds


def test_task_file_and_lines(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text(json.dumps([{"id": "b", "instruction": "x"}, {"id": "a"}]))
    assert [r["id"] for r in files.task_file(spark, str(p), 1).collect()] == ["a"]
    q = tmp_path / "l.jsonl"
    q.write_text('{"key": "a", "value": "1"}\n\n{"key": "b"}\n')
    assert files.lines(spark, str(q), "key STRING, value STRING").count() == 2
    assert {(r["input"], r["key"]) for r in files.in_order(spark, [str(q), str(q)], "key STRING").collect()} == {(0, "a"), (0, "b"), (1, "a"), (1, "b")}


def test_rollouts_guard(spark, tmp_path):
    for n, rec in (("a", {"status": "complete", "split": "train", "task_id": "1"}), ("b", {"status": "error", "split": "dev"})):
        (tmp_path / f"{n}.json").write_text(json.dumps(rec))
    assert files.rollouts(spark, str(tmp_path), "train").count() == 1
    with pytest.raises(Exception, match="another split"):
        files.rollouts(spark, str(tmp_path), "dev").collect()


def test_bank_and_runs(spark, tmp_path):
    p = tmp_path / "bank.json"
    p.write_text(json.dumps([{"id": "1", "content": "c"}, {"id": "2", "content": "", "status": "active"}, {"id": "3", "content": "d", "status": "superseded"}]))
    assert [r["id"] for r in files.bank(spark, str(p)).collect()] == ["1"]
    for n in (3, 12):
        (tmp_path / f"iter_{n}.json").write_text("{}")
    assert files.last_checkpoint(spark, f"{tmp_path}/iter_*.json") == 12 and files.latest_run(spark, f"{tmp_path}/nothing*") is None


def test_memo_first_writer(spark, tmp_path):
    path = str(tmp_path / "memo")
    want = spark.createDataFrame([("a",), ("b",), (None,)], "key STRING")
    first = files.memoise(want, lambda k: k.withColumn("value", F.lit("1")), path)
    again = files.memoise(want, lambda k: k.withColumn("value", F.lit("2")), path)
    assert {(r["key"], r["value"]) for r in again.collect()} == {("a", "1"), ("b", "1")} == {(r["key"], r["value"]) for r in first.collect()}


def test_index_export_pool_pending(spark, tmp_path):
    d = spark.createDataFrame([(1, "red fox"), (2, None)], "k INT, t STRING")
    files.write_index(d, "k", tokens(F.col("t")), str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix" / "postings")).count() == 2
    q = spark.createDataFrame([(1, "fox"), (2, "owl")], "q INT, t STRING")
    got = retrieval.bm25_from_index(q, "q", tokens(F.col("t")), str(tmp_path / "ix"), "k").collect()
    assert [(r["q"], r["k"]) for r in got] == [(1, 1)] and got[0]["score"] > 0
    files.export(d, F.col("k") > 0, str(tmp_path / "x"))
    with pytest.raises(Exception):
        files.export(d, F.col("t").isNotNull(), str(tmp_path / "y"))
    assert files.grow_pool(d, str(tmp_path / "pool")) == 2 and files.grow_pool(d, str(tmp_path / "pool")) == 4
    for run, name in (("a", "summary.json"), ("b", "other.json"), ("c", "summary.json")):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / name).write_text("{}")
    assert sorted(r["run"] for r in files.completed_runs(spark, str(tmp_path / "runs" / "*" / "*.json")).collect()) == ["a", "c"]
    for game, kind, ok in (("one_cup", "pick", True), ("two_cup", "pick", False), ("one_pan", "pick", True), ("three_cup", "heat", True)):
        (tmp_path / "games" / game).mkdir(parents=True)
        (tmp_path / "games" / game / "game.json").write_text(f'{{"kind": "{kind}", "solvable": {str(ok).lower()}}}')
    assert [r["file"].split("/")[-2] for r in files.listed_games(spark, str(tmp_path / "games"), ["pick"], "cup").collect()] == ["one_cup"]
    done = spark.createDataFrame([(1, "complete"), (2, "error")], "k INT, status STRING")
    assert [r["k"] for r in files.pending(d.select("k"), done, "k").collect()] == [2]


def test_page_elements(spark):
    h = '<a href="x">Home <b>page</b></a><p>text</p><button>Go</button><a> </a>'
    assert spark.range(1).select(files.page_elements(F.lit(h))).first()[0] == ["Home page", "Go"]


def test_stream_counts_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(i, f"2024-01-01 {i % 20:02d}:10:00", "ab"[i % 2]) for i in range(100)], "i INT, at STRING, g STRING").withColumn("at", F.to_timestamp("at"))
    df.write.json(src)
    s = folds.folder(spark, src, "i INT, at TIMESTAMP, g STRING")
    folds.drain(folds.windowed_counts(s, "at", "g", late="1 hour"), str(tmp_path / "out"), str(tmp_path / "st"))
    got = {(r["start"], r["g"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["s"], r["g"]): r["n"] for r in df.groupBy(F.window("at", "1 hour").start.alias("s"), "g").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 4  # the last windows stay open


def test_crossings_and_first_writer_as_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("g", i) for i in range(9)] + [("h", 0)], "g STRING, i INT").coalesce(1).write.json(src)
    s = folds.folder(spark, src, "g STRING, i INT")
    folds.drain(folds.crossing_triggers(s, "g"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert [(r["g"], r["size"]) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("g", 9)]
    t = folds.folder(spark, src, "g STRING, i INT").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    folds.drain(folds.first_writer(t, "g", "at"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 2


def test_bank_stream_equals_the_batch_fold(spark, tmp_path):
    from loomtrace.operators import banks, retrieval

    ddl = "chain STRING, position INT, op STRING, target STRING, content STRING, scope STRING, task STRING, evidence ARRAY<INT>"
    ops = [("c", 1, "add", None, "one", "s", "t1", [0]), ("c", 2, "add", None, "ONE", "s", "t2", [0]), ("c", 3, "refine", "mem_000001", "one more", "s", "t3", [2]), ("c", 4, "replace", "mem_000007", "x", "s", "t4", [5]), ("c", 5, "add", None, "two", "", "t6", []), ("d", 1, "add", None, "one", "s", "t1", [0])]
    df = spark.createDataFrame(ops, ddl)
    df.where("position <= 2").write.json(str(tmp_path / "in"))
    run = lambda: folds.drain(folds.bank_events(folds.folder(spark, str(tmp_path / "in"), ddl)), str(tmp_path / "out"), str(tmp_path / "state"))
    run()
    df.where("position > 2").write.mode("append").json(str(tmp_path / "in"))
    run()
    got = {(r["chain"], r["position"]): (r["memory_id"], r["version"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("c", 1): ("mem_000001", 1, None), ("c", 2): (None, None, "duplicate_active_memory"), ("c", 3): ("mem_000001", 2, None), ("c", 4): (None, None, "unknown_or_inactive_target"), ("c", 5): (None, None, "missing_evidence_steps"), ("d", 1): ("mem_000001", 1, None)}
    last = {k[0]: v[1] for k, v in sorted(got.items()) if v[1]}
    assert last == {r["chain"]: r["version"] for r in banks.fold_operations(df).collect()}
