"""Rules on decisions, episodes and replies: known answers and edge cases."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import banks, rules, training


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_private_values_at_any_depth(spark):
    json = r'{"task": {"user_id": "U-7", "deep": [{"Order_ID": 99, "x": {"email": ["A@b.example", 5]}}]}, "phone_number": null, "order_id": 1.5, "note": "\"user_id\": \"no\""}'
    assert one(spark, rules.private_values(F.lit(json))) == ["5", "99", "a@b.example", "u-7"]
    assert one(spark, rules.private_values(F.lit(None).cast("string"))) == []
    assert "#ab12" in one(spark, rules.task_identifiers(F.lit('{"t": "see #AB12", "user_id": "Z"}')))


@pytest.mark.parametrize(
    "reply, want",
    [("search[red shoes]", "search[red shoes]"), ("I will\n`Click[BUY Now]`", "click[Buy now]"), ("so:\nsearch[<your query>]\nclick[back]", "click[Back]"), ("click[missing]", None), ("search[a\nb]", "search[a\nb]"), ("", None), (None, None), ("x" * 9000 + "\nclick[back]", "click[Back]")],
)
def test_page_action(spark, reply, want):
    got = rules.page_action(F.lit(reply).cast("string"), F.lit(True), F.array(F.lit("Buy now"), F.lit("Back")))
    assert one(spark, got) == want


def test_a_search_needs_the_bar(spark):
    assert one(spark, rules.page_action(F.lit("search[x]"), F.lit(False), F.array(F.lit("a")))) is None


@pytest.mark.parametrize(
    "reply, want",
    [("```sql\nEXPLORE: SELECT 1;\n```", "explore|SELECT 1"), ("first words\n`submit: SELECT a;;`", "submit|SELECT a"), ("explore:", None), ("SELECT 1", None), (None, None), ("Explore: SELECT a\nFROM b", "explore|SELECT a\nFROM b"), ("submit: " + "x" * 9000, "submit|" + "x" * 9000)],
)
def test_sql_command(spark, reply, want):
    assert one(spark, rules.sql_command(F.lit(reply).cast("string"))) == want


def test_episode_partition(spark):
    refs = ["1"]
    act = lambda k, **m: {"action": k, **m}
    steps, episodes = [], []
    for run in ("good", "failed", "gap", "late"):
        steps += [(run, 0, refs, act("click", ref="1"), False), (run, 1, refs, act("finish", answer="x"), run == "failed")]
    steps += [("gap", 2, refs, act("back"), False)]
    for run in ("good", "failed", "gap", "late"):
        for e in (1, 2):
            episodes += [(run, e, "preserve_recorded" if e == 1 else "corrected", 0, act("click", ref="9" if run == "late" else "1")), (run, e, "preserve_recorded" if e == 1 else "corrected", 1, act("finish", answer="x", note=str(e)))]
    episodes += [("good", 3, "corrected", 0, act("click", ref="1")), ("good", 3, "corrected", 1, act("finish", answer="x", note="2")), ("none", 1, "corrected", 0, act("back"))]
    s = spark.createDataFrame(steps, "run_id STRING, index INT, refs ARRAY<STRING>, action MAP<STRING,STRING>, failed BOOLEAN")
    e = spark.createDataFrame(episodes, "run_id STRING, episode INT, mode STRING, source_step INT, action MAP<STRING,STRING>")
    r = spark.createDataFrame([("good", True), ("failed", True), ("gap", True), ("late", None)], "run_id STRING, success BOOLEAN")
    got = {(x["run_id"], x["episode"]): (x["status"], x["reason"]) for x in rules.episode_partition(e, s, r).collect()}
    assert got == {
        ("good", 1): ("accepted", None), ("good", 2): ("accepted", None), ("good", 3): ("rejected", "duplicate_episode"), ("failed", 1): ("rejected", "preserve_recorded_requires_successful_error_free_trajectory"), ("failed", 2): ("needs_replay", None),
        ("gap", 1): ("rejected", "incomplete_or_nonconsecutive_episode"), ("gap", 2): ("rejected", "incomplete_or_nonconsecutive_episode"), ("late", 1): ("rejected", "element_not_in_source_observation"), ("late", 2): ("rejected", "element_not_in_source_observation"), ("none", 1): ("rejected", "empty_source_trajectory"),
    }
    assert rules.episode_partition(e.limit(0), s, r).count() == 0


def test_evidence_union_keeps_the_first(spark):
    ev = lambda *xs: F.array(*[F.struct(F.lit(t).alias("task"), F.lit(s).alias("step"), F.lit(w).alias("w")) for t, s, w in xs])
    got = one(spark, rules.evidence_union(ev(("a", 1, "old"), ("a", 2, "old")), ev(("a", 2, "new"), ("b", 2, "new"), ("b", 2, "again"))))
    assert [tuple(x) for x in got] == [("a", 1, "old"), ("a", 2, "old"), ("b", 2, "new")]


def test_probes_and_placebos(spark):
    t = spark.createDataFrame([("a", "a1", True), ("a", "a2", True), ("a", "a3", False), ("b", "b1", True), ("c", "c1", None)], "g STRING, t STRING, ok BOOLEAN")
    got = {r["t"]: (r["probes"], r["probe"]) for r in rules.group_probes(t, "g", "t", "ok").collect()}
    assert got == {"a1": (1, "a2"), "a2": (1, "a1"), "a3": (2, "a1"), "b1": (0, None), "c1": (0, None)}
    for r in rules.placebos(t.select("g", "t"), "g", "t").collect():
        assert r["placebo"][0] != r["g"]
    assert rules.placebos(t.where("g = 'b'").select("g", "t"), "g", "t").first()["placebo"] is None
    assert rules.placebos(t.limit(0).select("g", "t"), "g", "t").count() == 0


def test_fitting_keeps_head_and_tail(spark):
    words = F.array(*map(F.lit, "s1 s2 a b c d e f".split()))
    assert one(spark, training.fitting(words, F.slice(words, 1, 2), 8)) == "s1 s2 a b c d e f".split()
    assert one(spark, training.fitting(words, F.slice(words, 1, 2), 5)) == "s1 s2 d e f".split()
    assert one(spark, training.fitting(words, F.slice(words, 1, 2), 1)) == "s1 s2 f".split()


def test_a_bank_handed_over_equals_one_fold(spark):
    ops = [("c", k, "add" if k % 3 == 0 else "refine" if k % 3 == 1 else "replace", f"mem_{k % 5 + 1:06d}", f"text {k % 7}", "s", f"t{k}", [k]) for k in range(25)] + [("d", 3, "add", None, None, None, "t", [1]), ("d", 11, "refine", "mem_000001", "new", "", "t", None)]
    df = spark.createDataFrame(ops, "chain STRING, position INT, op STRING, target STRING, content STRING, scope STRING, task STRING, evidence ARRAY<INT>")
    whole = sorted(map(str, banks.fold_operations(df).collect()))
    first = banks.fold_operations(df.where("position < 10"))
    assert sorted(map(str, banks.fold_operations(df.where("position >= 10"), first).collect())) == whole
    assert banks.fold_operations(df.limit(0)).count() == 0


def test_merging_bank_equals_a_plain_one(spark):
    rows = [("c", k, t) for k, t in enumerate(["the red ferry leaves at nine", "red ferry leaves at ten", "a blue lamp", None, "ferry red nine ten eleven twelve noon", "blue lamp on the wall of the house by the road"])]
    got = {r["id"]: (r["content"], r["version"]) for r in banks.fold_merging(spark.createDataFrame(rows, "chain STRING, position INT, content STRING")).collect()}
    assert len(got) >= 2 and sum(v for _, v in got.values()) == len(rows)
    assert got["mem_000001"][1] >= 2 and "ferry" in got["mem_000001"][0]


@pytest.mark.parametrize(
    "reply, want",
    [("craft 4 planks using 1 log", "craft 4 planks using 1 log"), ("First:\nAction: get 2 oak logs", "get 2 oak logs"), ("`INVENTORY`", "INVENTORY"), ("get some logs", None), ("inventory now", None), (None, None), ("", None)],
)
def test_crafting_command(spark, reply, want):
    assert one(spark, rules.crafting_command(F.lit(reply).cast("string"))) == want


@pytest.mark.parametrize("reply, want", [("go north", "Go North"), ("I will\n`LOOK`\nnow", "look"), ("look around", None), (None, None), ("x" * 5000 + "\ngo NORTH", "Go North")])
def test_admissible_command(spark, reply, want):
    assert one(spark, rules.admissible_command(F.lit(reply).cast("string"), F.array(F.lit("Go North"), F.lit("look")))) == want


def plain_merging(drafts, threshold=0.25, keep=0.9):
    from loomtrace.functions.text import RANKING_STOPWORDS

    words = lambda t: set(re.findall("[a-z0-9]+", t.lower())) - set(RANKING_STOPWORDS)
    bank = []
    for t in drafts:
        new = words(t)
        best = max(((len(new & words(e[0])) / len(new | words(e[0])), -i) for i, e in enumerate(bank) if new & words(e[0])), default=(0, 0))
        if best[0] < threshold:
            bank.append([t, 1])
        else:
            e = bank[-best[1]]
            old = words(e[0])
            e[:] = [f"{e[0]} {t}" if len(new & old) / len(old) < keep and t not in e[0] else t, e[1] + 1]
    return bank


def test_a_merging_bank_of_many_entries(spark):
    rng = random.Random(4)
    common = [f"c{k}" for k in range(12)]
    drafts = []
    for k in range(900):
        t = rng.sample(common, rng.randint(0, 6)) + [f"r{rng.randrange(6000)}" for _ in range(rng.randint(0, 9))]
        drafts.append(rng.choice([" ".join(t), " ".join(t).upper(), rng.choice(drafts or [""]), " ".join(rng.choice(drafts or [""]).split()[:4])]))
    want = plain_merging(drafts)
    assert len(want) > 256 and max(v for _, v in want) > 3
    df = spark.createDataFrame([("c", k, t) for k, t in enumerate(drafts)], "chain STRING, position INT, content STRING")
    got = {r["id"]: [r["content"], r["version"]] for r in banks.fold_merging(df).collect()}
    assert got == {f"mem_{i + 1:06d}": e for i, e in enumerate(want)}


def test_a_long_chain_of_drafts_with_common_words_folds_in_time(spark):
    common = " ".join(f"c{k}" for k in range(60))
    df = spark.range(5000).selectExpr("'c' AS chain", "id AS position", f"concat('{common} ', array_join(transform(sequence(1, 150), i -> concat('w', id, 'x', i)), ' ')) AS content").cache()
    df.count()
    began = time.time()
    assert banks.fold_merging(df).count() == 5000
    assert time.time() - began < 25  # 60 words in all entries: 750 million meetings of a draft and an entry
