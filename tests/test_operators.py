"""Operators on small fixtures with known answers."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.functions import text as tx
from loomtrace.operators import banks, evaluation, policy, retrieval, selection, similarity, training, validation, windows


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_index_set_keeps_only_whole_numbers(spark):
    assert one(spark, tx.json_index_set(F.col("t")), t='[2,1,2,true,"3",-1]') == [1, 2]


def test_json_of_replies(spark):
    for t in ('{"a": 1}', 'text ```json\n{"a": 1}\n``` more', 'so: {"a": 1}.'):
        assert one(spark, tx.json_object(F.col("t")), t=t) == '{"a":1}'
    assert one(spark, tx.json_object(F.col("t")), t="no object") is None


def test_answer_patterns(spark):
    df = spark.createDataFrame([("Apache 2.0", ["Apache", r"2(\.0)?"]), ("MIT", ["Apache"]), ("x", []), (None, ["a"])], "a STRING, p ARRAY<STRING>")
    assert [r[0] for r in df.select(validation.all_match(F.col("p"), F.col("a"))).collect()] == [True, False, False, False]


def test_first_divergence(spark):
    df = spark.createDataFrame([("abc", "abd"), ("abc", "abc"), ("ab", "abc"), ("", "x")], "a STRING, b STRING")
    assert [r[0] for r in df.select(tx.first_divergence(F.col("a"), F.col("b"))).collect()] == [2, None, 2, 0]


def test_divergence_beyond_200_characters(spark, tmp_path):
    from loomtrace.plans import QUERIES

    pairs = [("x" * 250 + "a", "x" * 250 + "b"), ("é😀" * 150, "é😀" * 150 + "z"), ("y" * 300, "y" * 300), ("y" * 200, "y" * 201), ("", "")]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "reply_id BIGINT, content STRING, prompt STRING")
    df.write.parquet(str(tmp_path / "model_replies.parquet"))
    assert {r["reply_id"]: r["at"] for r in QUERIES["divergence_index"](spark, str(tmp_path)).collect()} == {0: 250, 1: 300, 2: None, 3: 200, 4: None}


def test_identifiers_and_leak(spark):
    got = one(spark, tx.identifiers(F.col("t")), t="Order #ab12-9 of ABC123, mail x.y@z.org, call 555-123-4567, ENTREGÓ")
    assert got == sorted(["#ab12-9", "abc123", "x.y@z.org", "555-123-4567"])
    assert one(spark, tx.leaked(F.array(F.lit("abc123"), F.lit("zzz999")), F.col("t")), t="seat of ABC123") == ["abc123"]


def test_hashed_bag_matches_md5(spark):
    import hashlib

    words = ["harbour", "ferry", "ferry"]
    want = [0.0] * 16
    for w in words:
        want[int(hashlib.md5(w.encode()).hexdigest(), 16) % 16] += 1 / 3
    got = one(spark, tx.hashed_bag(F.array(*map(F.lit, words))))
    assert np.allclose(got, want)
    assert one(spark, tx.hashed_bag(F.array().cast("array<string>"))) == [0.0] * 16


def test_bm25_equals_plain_python(spark):
    docs = [(1, "red fox and red hen"), (2, "the hen house"), (3, ""), (4, None), (5, "fox fox fox fox")]
    queries = [("q", "red fox fox fox fox hen"), ("none", "and the of"), ("null", None)]
    d, q = spark.createDataFrame(docs, "k INT, t STRING"), spark.createDataFrame(queries, "q STRING, t STRING")
    w = lambda t: [x for x in re.findall("[a-z0-9]+", (t or "").lower()) if x not in tx.RETRIEVAL_STOPWORDS]
    bags = {k: w(t) for k, t in docs}
    avg = sum(map(len, bags.values())) / len(bags)
    want = {}
    for k, b in bags.items():
        s, c = 0.0, Counter(b)
        for t, n in Counter(w(queries[0][1])).items():
            df = sum(t in x for x in bags.values())
            if c[t]:
                s += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(b) / max(avg, 1))) * min(n, 3)
        if s:
            want[("q", k)] = s
    got = {(r["q"], r["k"]): r["score"] for r in retrieval.bm25_scores(q, "q", tx.tokens(F.col("t")), d, "k", tx.tokens(F.col("t"))).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    empty = retrieval.bm25_scores(q.limit(0), "q", tx.tokens(F.col("t")), d.limit(0), "k", tx.tokens(F.col("t")))
    assert empty.count() == 0


def test_overlap_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(1, 6)))) for i in range(60)] + [(90, ""), (91, None)]
    df = spark.createDataFrame(rows, "k INT, t STRING")
    got = {(r["k"], r["other"]): r["overlap"] for r in similarity.earlier_overlaps(df, "k", F.split("t", " "), 0.5).collect()}
    sets = {k: set(t.split(" ")) for k, t in rows if t is not None}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if b < a and sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert got == pytest.approx(want)


def test_utility_of_pairs(spark):
    r = evaluation.utility(spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (1.0, 1.0)], "a DOUBLE, b DOUBLE")).first()
    assert (r["helped"], r["hurt"], r["unchanged_positive"]) == (1, 1, 1) and abs(r["net"] + 1 / 3) < 1e-9
    none = evaluation.utility(spark.createDataFrame([], "a DOUBLE, b DOUBLE")).first()
    assert none["n"] == 0 and none["net"] is None


def test_correlation_of_constants_is_null(spark):
    assert evaluation.correlation(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x DOUBLE, y DOUBLE"), F.col("x"), F.col("y")).first()["r"] is None


def test_upper_median(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9)] + [("b", 7)], "g STRING, v INT")
    assert {r["g"]: r["p50"] for r in evaluation.upper_median_by_counts(df, "g", "v").collect()} == {"a": 5, "b": 7}


def test_advantages_sum_to_zero(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.9), ("b", 0.5)], "g STRING, v DOUBLE")
    s = windows.group_advantage(df, ["g"], "v").groupBy("g").agg(F.sum("advantage").alias("s")).collect()
    assert all(abs(r["s"]) < 1e-12 for r in s)


def test_newest_first_budget(spark):
    df = spark.createDataFrame([("g", i, 20) for i in range(1, 11)], "g STRING, i INT, n INT")
    assert sorted(r["i"] for r in windows.newest_first(df, "g", "i", F.col("n"), 65).collect()) == [8, 9, 10]
    assert [r["i"] for r in windows.newest_first(df, "g", "i", F.col("n"), 5).collect()] == [10]


def test_two_ended_takes_the_tail_first(spark):
    df = spark.createDataFrame([("g", i, 10) for i in range(6)], "g STRING, i INT, n INT")
    kept = lambda most: sorted(r["i"] for r in windows.two_ended(df, "g", "i", F.col("n"), most).where("kept").collect())
    assert kept(30) == [0, 4, 5] and kept(10) == [5] and kept(60) == list(range(6)) and kept(5) == []


def test_strikes(spark):
    df = spark.createDataFrame([("g", i, b) for i, b in enumerate([True, True, False, True, True, True])], "g STRING, i INT, b BOOLEAN")
    assert [r["i"] for r in windows.strikes(df, "g", "i", F.col("b")).where("out").collect()] == [5]


def test_near_equal_chunks(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert sorted(Counter(r["chunk"] for r in selection.chunks(df, ["k"], 3, 10).collect()).items()) == [(0, 4), (1, 3), (2, 3)]


def test_ranked_equals_row_number(spark):
    df = spark.createDataFrame([(g, i) for g in "aab" for i in range(50)], "g STRING, i INT").distinct()
    got = {(r["g"], r["i"]): (r["turn"], r["n"]) for r in selection.ranked(df, "g", ["i"]).collect()}
    assert got == {(g, i): (i + 1, 50) for g in "ab" for i in range(50)}


def test_exact_selection_fails_when_short(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k STRING, i INT")
    with pytest.raises(ValueError):
        selection.exact_unique(df, ["k"], ["i"], 2, must=True)


def test_candidate_gate(spark):
    steps, auth = F.array(F.lit(0), F.lit(1), F.lit(2)), F.array(F.lit(2))
    gate = lambda ev: one(spark, validation.candidate_reasons(F.lit("add"), F.lit("c"), F.lit("s"), F.lit(0.5), F.array(*[F.lit(e) for e in ev]).cast("array<int>"), steps, auth))
    assert gate([1, 2]) == [] and gate([1]) == ["no_authoritative_message_in_evidence"] and gate([7]) == ["invalid_evidence_step"] and gate([]) == ["missing_evidence_steps"]


def test_chat_shapes(spark):
    why = lambda *r: one(spark, validation.chat_reason(F.array(*map(F.lit, r)), F.array(*[F.lit("x") for _ in r])))
    assert why("system", "user", "assistant") is None
    assert why("system", "user") == "too_short" and why("user", "user", "assistant") == "first_not_system" and why("system", "assistant", "user") == "roles_do_not_alternate"


def test_fold_of_operations(spark):
    ops = [
        ("c", 1, "add", None, "one", "s", "t1", [0]), ("c", 2, "add", None, "ONE", "s", "t2", [0]), ("c", 3, "refine", "mem_000001", "one more", "s", "t3", [2, 3]),
        ("c", 4, "replace", "mem_000001", "other", "s", "t4", [5]), ("c", 5, "refine", "mem_000009", "x", "s", "t5", [1]), ("c", 6, "add", None, "two", "", "t6", []), ("d", 1, "add", None, "one", "s", "t1", [0]),
    ]
    got = {(r["chain"], r["id"]): r for r in banks.fold_operations(spark.createDataFrame(ops, "chain STRING, position INT, op STRING, target STRING, content STRING, scope STRING, task STRING, evidence ARRAY<INT>")).collect()}
    assert set(got) == {("c", "mem_000001"), ("d", "mem_000001")}
    c = got[("c", "mem_000001")]
    assert (c["content"], c["version"], c["n_history"], c["evidence"]) == ("other", 3, 2, ["t4:5"])


def test_each_target_as_its_reader_sees_it(spark):
    log = spark.createDataFrame([(1, 1, None), (2, 600, 1), (3, 700, None)], "id INT, position INT, supersedes INT")
    readers = spark.createDataFrame([(1, 500, 1), (2, 600, 1), (3, 601, 1), (4, 700, 3), (5, 701, 3), (6, 900, 9), (7, 900, None)], "reader INT, at INT, target INT")
    got = {r["reader"]: r["visible"] for r in banks.targets_as_of(readers, log, "id", "supersedes", "position").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False}


def test_refining_keeps_evidence(spark):
    ops = [("c", 1, "add", None, "one", "s", "old", [2]), ("c", 2, "refine", "mem_000001", "one!", "s", "new", [0])]
    r = banks.fold_operations(spark.createDataFrame(ops, "chain STRING, position INT, op STRING, target STRING, content STRING, scope STRING, task STRING, evidence ARRAY<INT>")).first()
    assert r["evidence"] == ["old:2", "new:0"]


def test_policy_matches_numpy(spark):
    z = [0.1, -2.0, 3.0, 3.0]
    p = np.exp(z) / np.exp(z).sum()
    col = policy.softmax(F.array(*map(F.lit, z)))
    assert np.allclose(one(spark, col), p)
    assert one(spark, policy.argmax(col)) == 2
    assert abs(one(spark, policy.entropy(col)) + (p * np.log(p)).sum()) < 1e-9
    assert one(spark, policy.sampled(col, F.lit(0.0))) == 0 and one(spark, policy.sampled(col, F.lit(0.9999999))) == 3


def test_features_have_35_numbers(spark):
    x = one(spark, policy.features(F.lit(True), F.lit(None).cast("double"), F.lit(4), F.lit("harbour"), F.lit(None).cast("string")))
    assert len(x) == 35 and x[0] == 1 and x[1] == 0 and abs(x[2] - 0.2) < 1e-9 and sum(x[3:19]) == 1 and sum(x[19:]) == 0


def test_loss_mask(spark):
    assert one(spark, training.loss_mask(F.array(*map(F.lit, ["u", "<a>", "x", "y", "<e>", "u", "<a>", "z"])), "<a>", "<e>")) == [0, 0, 1, 1, 1, 0, 0, 1]


def test_episode_status_of_made_runs(spark):
    el = "STRUCT<url STRING, title STRING, text STRING, elements ARRAY<STRUCT<ref INT, tag STRING, role STRING, name STRING, placeholder STRING>>>"
    ob = (None, None, "t", [(1, "a", "", "x", "")])
    mk = lambda sid, run, i, act, err=None: (sid, run, i, ob, act, err)
    rows = [
        mk(1, "ok", 0, {"action": "click", "ref": "1"}), mk(2, "ok", 1, {"action": "finish", "answer": "a"}), mk(3, "gap", 1, {"action": "finish", "answer": "a"}), mk(4, "open", 0, {"action": "back"}),
        mk(5, "bad", 0, {"action": "click", "ref": "9"}), mk(6, "bad", 1, {"action": "finish", "answer": "a"}), mk(7, "lost", 0, {"action": "finish", "answer": "a"}),
    ]
    steps = spark.createDataFrame(rows, f"step_id BIGINT, run_id STRING, index INT, observation {el}, action MAP<STRING,STRING>, execution_error STRING")
    runs = spark.createDataFrame([("ok", True), ("lost", False)], "run_id STRING, success BOOLEAN")
    got = {r["run_id"]: (r["status"], r["reason"]) for r in validation.episode_reasons(steps, runs).collect()}
    assert got == {
        "ok": ("accepted", None), "gap": ("rejected", "incomplete_or_nonconsecutive_episode"), "open": ("rejected", "missing_terminal_finish"), "bad": ("rejected", "element_not_in_source_observation"), "lost": ("needs_replay", None),
    }


def test_closest_hints(spark):
    df = spark.createDataFrame([("go kitchn", ["go kitchen", "open door"]), ("zzz", ["a"]), (None, ["a"])], "t STRING, o ARRAY<STRING>")
    assert [r[0] for r in df.select(tx.closest_hints()("t", "o")).collect()] == [["go kitchen"], [], []]


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"id": 3, "c": 2}}',), (None,), ("text",)], "t STRING")
    assert [r[0] for r in df.select(tx.canonical_json("t")).collect()] == ['{"a": {"c": 2}, "b": 1}', None, "text"]
