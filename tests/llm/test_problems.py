"""The operators of the nine problems on small fixtures: brute-force versions, round trips, edge cases."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtrace.llm import abuse, conversations, packing, page_body, pieces, queries, repeats, replies, residue, tokens
from loomtrace.llm.common import is_shown
from tests.conftest import DATA

STEP = "step_id BIGINT, run_id STRING, index INT, observation STRUCT<url: STRING, title: STRING, text: STRING, elements: ARRAY<STRUCT<ref: INT, tag: STRING, role: STRING, name: STRING, placeholder: STRING>>>, action MAP<STRING,STRING>, execution_error STRING, started_at TIMESTAMP_NTZ, ended_at TIMESTAMP_NTZ, junk STRING"
T0 = datetime.datetime(2026, 1, 1)


def step(sid, run="r", i=0, text=None, action=None, error=None, title=None, url="https://www.old-mill.example/p/x", elements=None):
    return (sid, run, i, (url, title, text, elements), action, error, T0, T0 + datetime.timedelta(seconds=(i or 0) + 1), "x")


def frame(spark, rows):
    return spark.createDataFrame(rows, STEP)


LIMITS = [("observation.text", "character", 200, 20), ("observation.elements", "element", 10, 2), ("documents.text", "token", 50, 0)]


# 1 ---------------------------------------------------------------------------------------------------------------


def check_cuts(n, got, size, overlap):
    assert got[0][0] == 0 and got[-1][1] == n
    for b, e in got:
        assert 0 < e - b <= size
    for (_, e), (b, _) in zip(got, got[1:]):
        assert b <= e - overlap and b > e - 2 * overlap - 1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc .\n。é😀", min_size=201, max_size=3000))
def test_pieces_cover_and_overlap(text):
    got = pieces.text_pieces(text, 200, 20)
    check_cuts(len(text), got, 200, 20)


def test_an_edit_moves_only_near_cuts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(6000)]
    a = " ".join(words) + "."
    b = a[:500] + "changed words here " + a[500:]
    tail = lambda t: {t[e - 30 : e] for _, e in pieces.text_pieces(t, 2000, 100)}
    x, y = tail(a), tail(b)
    assert len(x & y) >= 0.6 * len(x)


def test_an_edit_moves_only_near_cuts_without_boundaries():
    rng = random.Random(6)
    a = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(120_000))
    cut = lambda t: [t[b:e] for b, e in pieces.text_pieces(t, 2000, 100)]
    before, after = cut(a), set(cut(a[:100] + "字" + a[100:]))
    assert sum(p in after for p in before) >= 0.9 * len(before)
    check_cuts(len(a), pieces.text_pieces(a, 2000, 100), 2000, 100)


def test_pieces_of_steps(spark):
    el = [(i, "a" if i < 13 else "input", "", str(i), "") for i in range(25)]
    rows = [step(1, text="word " * 100), step(1, text="word " * 100), step(2, text=""), step(3), step(4, text="x" * 450), step(5, elements=el), step(6, text="é" * 200), step(None, text="word " * 100)]
    lim = spark.createDataFrame(LIMITS, "field STRING, unit STRING, max_size INT, overlap INT")
    df = frame(spark, rows)
    got = sorted(pieces.observation_pieces(df, lim).collect(), key=lambda r: (r["step_id"], r["piece_no"]))
    assert {(r["step_id"], r["field"]) for r in got} == {(1, "text"), (4, "text"), (5, "elements")}
    for r in got:
        assert len(r["piece"] or r["items"]) == r["end"] - r["begin"]
    assert [r["items"][0]["ref"] for r in got if r["step_id"] == 5] == [r["begin"] for r in got if r["step_id"] == 5]
    assert {tuple(r) for r in pieces.oversized(df, lim).collect()} == {(1, "text"), (4, "text"), (5, "elements")}
    assert pieces.observation_pieces(df.limit(0), lim).count() == 0


# 2, 3 ------------------------------------------------------------------------------------------------------------

VOCAB = "ferry bread winter light boat noon harbour map stone river letter garden lamp road wheel paper summer bridge tower window music field horse coat bell clock wool glass market roof".split()
MENU = ["Home", "About us", "Contact", "Catalogue", "Archive", "Press"]
CONSENT = "We use cookies on your device; you can change it at any time."


def site(host, n, seed=1, menu=MENU, consent=CONSENT):
    """(step rows, {step_id: numbers of frame lines}) of a made-up site: menu, breadcrumb, heading, body, box, footer."""
    rng = random.Random(seed)
    sentence = lambda: (" ".join(rng.choices(VOCAB, k=rng.randint(9, 16))) + " " + "".join(rng.choices("abcdefgh", k=6))).capitalize() + "."
    titles = [f"{rng.choice(VOCAB).capitalize()} {''.join(rng.choices('klmnop', k=5))}" for _ in range(n)]
    rows, want = [], {}
    for k in range(n):
        lines = [(x, 1) for x in menu] + [("", 0), (f"{menu[0]} › {menu[2]} › {titles[k]}", 1), ("", 0), (titles[k], 0), *((" ".join(sentence() for _ in range(3)), 0) for _ in range(4)), ("", 0), ("You may also like", 1)]
        lines += [(f"{t}", 1) for t in rng.sample(titles, 3) if t != titles[k]] + [("", 0), ("© 2026 Old Mill. All rights reserved.", 1), (consent, 1)]
        rows.append(step(seed * 1000 + k, text="\n".join(x for x, _ in lines), title=f"{titles[k]} | Old Mill", url=f"https://{host}/p/{k}"))
        want[seed * 1000 + k] = {i for i, (_, f) in enumerate(lines) if f}
    return rows, want


def scores(got, want):
    true = {(s, i) for s, v in want.items() for i in v}
    return len(got & true) / len(true), len(got & true) / max(1, len(got))


#: Sites past what once was capped: a menu of 60 lines above the heading, a menu in one line of 700 characters, a consent notice of 900.
SITES = [("www.old-mill.example", 40, 1), ("b.example", 30, 2, [f"{w.capitalize()} service" for w in VOCAB] * 2), ("c.example", 30, 3, [" | ".join(f"{w} desk" for w in VOCAB * 2), "Sign in", "Basket (3)"]), ("d.example", 30, 4, MENU, " ".join([CONSENT] * 15))]


def test_frame_lines_of_sites(spark, monkeypatch):
    rows, want = [], {}
    for s in SITES:
        r, w = site(*s)
        rows += r
        want |= w
    extra = [step(90, text=""), step(91), step(92, text="\u200b\n \n"), step(93, text="A line without an address.", url=None), step(None, text="x")]
    df = frame(spark, rows + rows[:20] + extra)
    got = [tuple(r) for r in page_body.frame_rows(df).collect()]
    assert len(set(got)) == len(got)
    found = {g for g in got if g[0] >= 1000}
    recall, precision = scores(found, want)
    assert recall >= 0.9 and precision >= 0.95
    for k in range(1, 5):
        assert scores({g for g in found if g[0] // 1000 == k}, {s: v for s, v in want.items() if s // 1000 == k})[0] >= 0.85, k
    assert {tuple(r) for r in page_body.frame_rows(df, broadcast=0).collect()} == set(got)  # the joined way
    body = {r["step_id"]: (r["body"], r["n_lines"]) for r in page_body.main_bodies(df).collect()}
    assert body[91] == (None, None) and body[90] == ("", 1) and len(body) == len(rows) + 4
    text = {r[0]: r[3][2].split("\n") for r in rows}
    gone = {s: {i for t, i in got if t == s} for s in text}
    assert all(body[s][0] == "\n".join(x for i, x in enumerate(v) if i not in gone[s]) for s, v in text.items())
    assert page_body.frame_rows(df.limit(0)).count() == 0 and page_body.main_bodies(df.limit(0)).count() == 0


def test_rows_come_from_the_clusters():
    rows, want = site(*SITES[0])
    pages = [(r[3][2], r[3][1], 7) for r in rows]
    none = page_body.Recurrence(np.empty(0, np.int64), np.empty(0))
    seen = lambda: {(r[0], i) for r, f in zip(rows, page_body.frame_lines(pages, none)[0]) for i in f}
    assert scores(seen(), want)[0] > 0.3  # without counts: what the lines show by themselves
    smooth, mask, page = page_body.smoothed([np.ones((3, len(page_body.WEIGHTS)))] * 2, [np.ones(3)] * 2)
    assert len(smooth) == 2 * (3 + page_body.REACH) and mask.sum() == 6 and page.max() == 1
    dense = page_body.clustered(np.array([-9.0, -8, 7, 9, 8, 0]), np.array([1, 1, 1, 1, 1, 0]), np.zeros(6, int), 1)
    assert dense[:5].tolist() == [False, False, True, True, True]


def test_recurrences_count_distinct_pages(spark):
    rows = [step(i, text=f"Zeile der Mühle {i % 3}\nInhalt {chr(97 + i)}", url=f"https://a.example/{i}") for i in range(12)] + [step(99, text="Zeile der Mühle 1", url="https://a.example/1?x=2")] * 30
    got = {r["entry"]: r["code"] for r in page_body.recurrences(frame(spark, rows)).collect()}
    host = page_body.xxhash64(b"a.example")
    assert got == {host ^ page_body.line_key("Zeile der Mühle 7"): 3}


@pytest.mark.parametrize("line", ["Dear {{ name }}, welcome.", "Welcome back, %%first%%!", "Results for undefined in undefined", "Lorem ipsum dolor sit amet", "TODO: write description", "[object Object]", "Posted by <author> on <price>"])
def test_residue_in_place(line):
    assert residue.judged(line)[0]


@pytest.mark.parametrize("line", ["Write {{ name }} where the name shall stand.", "The set {a, b, c} has eight subsets.", "A sum over null rows stays null, and a mean of nothing is NaN.", '{"ref": 12, "tag": "button"}', "Printers used scrambled Latin that began with lorem ipsum in empty columns.", "TODO: paint the fence"])
def test_explanations_are_no_residue(line):
    assert not residue.judged(line)[0]


@pytest.mark.parametrize("error, bad", [("Error: {{ error.text }}", True), ("%s: %s", True), ("Error: undefined", True), ("Error: Page not found. The page you are looking for does not exist.", True), ("Error: You need to enable JavaScript to run this app.", True), ('Error: ref 3 is covered by <div id="overlay">', False), ("ValueError: Unsupported action: {}", False), ("TypeError: expected {'text': str}, got {'text': None}", False), ("Error: net::ERR_HTTP_RESPONSE_CODE_FAILURE 404 at https://a.example/todo", False), ("", False), (" ", False)])
def test_error_reports(error, bad):
    assert residue.error_fails(error) == bad


FULL = "The ferry left at nine and came back at noon with bread and butter. " * 12
#: Wordings held out from the lists, and lengths past what once was capped.
FAILING = ["HTTP/1.1 503 upstream connect error or disconnect/reset before headers", "Diese Anwendung läuft nur mit eingeschaltetem JavaScript", "[[FIRST NAME]]", "Access denied\n" + "We keep a record of this visit and of the address that it came from, as the rules of the house ask us to.", "Something went wrong " + "while the page was put together " * 20, "<html><head></head><body>" + "<p></p>" * 60 + "502 Bad Gateway</body></html>"]


@pytest.mark.parametrize("text", FAILING)
def test_failing_pages(text):
    lines = text.split("\n")
    assert residue.page_fails(text, None, [], np.zeros(len(lines), int))
    assert not residue.page_fails(f"{FULL}\nThe map needs JavaScript and is not shown.", None, [], np.zeros(2, int))


def test_recurrent_lines_are_subtracted():
    text = "Access denied\nLorem ipsum dolor sit amet"
    assert residue.page_fails(text, None, [], np.array([0, 0])) and not residue.page_fails(text, None, [], np.array([3, 3]))
    assert not residue.page_fails("Writing a good error page\nA 404 status tells that the server has no such page.", "Writing a good error page", [], np.zeros(2, int))
    assert not residue.page_fails("It said “Oops! Something went wrong” to us.", None, [], np.zeros(1, int))


def test_failing_fields(spark):
    rows = [
        step(1, text="Access denied\nIncident X-1", title="Error"), step(1, text="Access denied\nIncident X-1", title="Error"), step(2, text=f"{FULL}\nScripts are off", url=None),
        step(3, text="Fine.", error="Error: ${err.message}"), step(4), step(5, text="", error=""), step(6, text="This site requires scripts. Turn them on in your browser settings and reload."),
    ]
    df = frame(spark, rows)
    want = {(1, "text"), (3, "execution_error"), (6, "text")}
    assert {tuple(r) for r in residue.failing_fields(df).collect()} == want == {tuple(r) for r in residue.failing_fields(df, broadcast=0).collect()}
    kept = {r["step_id"]: (r["text"], r["execution_error"]) for r in residue.kept_steps(df).collect()}
    assert kept[1] == (None, None) and kept[3] == ("Fine.", None) and kept[4] == (None, None) and kept[5] == ("", "") and len(kept) == 6
    assert residue.failing_fields(df.limit(0)).count() == 0


# 4 ---------------------------------------------------------------------------------------------------------------

Q = "Which road from Old Mill to New Mill is shorter?"
GOOD = ["The northern road is shorter, but it is closed on weekdays.", f"{Q} The route along the canal is shorter.", "12 km", "No.", "The office says it cannot help with this on weekends, so write to them before noon."]
CASES = {"empty": [None, "", " ​\n", "{}", '{"answer": " "}'], "truncated": ["The northern road is shorter, but it is closed on week", '{"action": "finish", "answer": "The northern road is short'], "refusal": ["I'm sorry, but I can't help with that request.", "As an assistant I must decline to answer."], "copied_question": [Q, f"You asked: {Q}", Q[:-1]], "wrong_language": ["Der Weg führt am alten Kanal entlang und dauert zwölf Minuten.", "Il vaut mieux prendre le bus, qui ne roule qu'en semaine."]}


def test_defects(spark):
    rows, want = [], {}
    for k, c in enumerate(GOOD * 6):
        rows.append((k, Q, c))
    for k in range(30, 110):
        rows.append((k, f"What does item {k} cost in {VOCAB[k % 30]} street?", f"The item in {VOCAB[k * 7 % 30]} street costs {k} crowns without delivery. The {VOCAB[k * 3 % 30]} is closed on weekdays and in the {VOCAB[k * 5 % 30]}."))
    n = len(rows)
    for d, cs in CASES.items():
        for c in cs:
            rows += [(n, Q, c), (n, Q, c)]
            want[n] = d
            n += 1
    rows.append((n, "Antworte auf Englisch: Was kostet der Artikel?", "The price of the item is twelve crowns without the delivery."))
    rows += [(n + 1, None, "It is closed on weekdays and costs two crowns."), (None, Q, None)]
    rows = [(*r, "stop" if k % 2 else None, {"answer": r[2]} if k % 3 == 0 and r[2] else None, "x") for k, r in enumerate(rows)]
    schema = "reply_id BIGINT, prompt STRING, content STRING, finish_reason STRING, parsed MAP<STRING,STRING>, defect STRING"
    got = {r["reply_id"]: r["defect"] for r in replies.defects(spark.createDataFrame(rows, schema)).collect()}
    assert got == want
    assert replies.defects(spark.createDataFrame([], schema)).count() == 0


REFUSALS = ["I'm sorry, but I can't help with that request.", "As an assistant I must decline to answer.", "I will not comment on such a request.", "I am not able to help with that, sorry.", "Unfortunately it is outside what I may do.", "I would rather not answer a request of this kind.", "My guidelines do not allow me to help with that."]


def test_the_field_knows_more_than_its_labels():
    """Wordings that no rule labels, and measurements that no rule reads."""
    rng = random.Random(3)
    rows = [(Q, c, None, None) for c in GOOD * 6] + [(Q, c, "stop", None) for c in REFUSALS * 8] + [(f"What does item {k} cost?", f"The item costs {rng.randint(2, 90)} crowns without delivery.", None, None) for k in range(40)]
    field = replies.trained(rows)
    held_out = ["That request falls outside what I may help with.", "Helping with such a request is not something for me, sorry."]
    for x in held_out:
        assert not replies._REFUSES.search(x) or x == held_out[0]
    assert replies.pair_defects(field, [(Q, x, None, None) for x in held_out]) == ["refusal", "refusal"]
    assert replies.trained(rows) is field
    long = " ".join(f"Stop {k} of the road is by the mill." for k in range(200))
    assert replies.pair_defects(field, [(Q, long, None, None), (Q, long + " The last stop is by the old", "length", None)]) == [None, "truncated"]


def test_field_learns_transitions():
    rng = np.random.default_rng(1)
    ys = [rng.integers(0, 3, 5) for _ in range(60)] + [rng.integers(0, 3, 40) for _ in range(5)]
    xs = [[[0, 100 + int(t)] for t in y] for y in ys]
    f = replies.Field().fit(xs, ys)
    got = f.tag(xs)
    assert np.mean(np.concatenate(got) == np.concatenate(ys)) > 0.98
    assert all(np.array_equal(a, f.tag([x])[0]) for a, x in zip(got, xs))


# 5 ---------------------------------------------------------------------------------------------------------------


def brute_conversations(rows):
    runs = {}
    for m, run, i, o, a in rows:
        if run is not None:
            runs.setdefault(run, {})[m] = (i, o, a)
    out = set()
    for run, ms in runs.items():
        by, ok = {}, None not in ms
        for m, (i, o, a) in ms.items():
            s = 0 if o is not None and a is None and is_shown(o) else 1 if a is not None and o is None and is_shown(a.get("action")) else 2
            ok &= s != 2 and i is not None
            if ok:
                by.setdefault(i, []).append((s, m))
        ix = sorted(by)
        if ok and ix and ix[0] in (0, 1) and ix == list(range(ix[0], ix[0] + len(ix))) and all(sorted(s for s, _ in v) == [0, 1] for v in by.values()):
            out |= {(run, 2 * (i - ix[0]) + s, m) for i in ix for s, m in by[i]}
    return out


def test_conversations_equal_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows, m = [], 0
    for r in range(30):
        start, n = rng.choice([0, 0, 1, 2]), rng.choice([1, 3, 300])
        for i in range(start, start + n):
            for s in (0, 1):
                m += 1
                rows.append((m, f"r{r}", i, "said" if s == 0 else None, {"action": "go"} if s else None))
        if r % 3 == 0:
            bad = rng.choice([(m + 1, f"r{r}", None, "x", None), (m + 1, f"r{r}", start, "x", None), (m + 1, f"r{r}", start + n, "​", None), (m + 1, f"r{r}", start + n, None, {}), (m + 1, f"r{r}", start + n + 2, "x", None)])
            rows.append(bad)
            m += 1
    rows += rng.sample(rows, 40) + [(m + 1, None, 0, "x", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, c, d, e, None if a % 7 == 0 else T0, None if a % 5 == 0 else T0 + datetime.timedelta(days=a % 90)) for a, b, c, d, e in rows], "message_id BIGINT, run_id STRING, index INT, observation STRING, action MAP<STRING,STRING>, sent_at TIMESTAMP_NTZ, ingested_at TIMESTAMP_NTZ")
    p = str(tmp_path / "m.parquet")
    df.repartition(3).write.parquet(p)
    got = {(r["run_id"], r["turn"], r["message_id"]) for r in conversations.conversations(spark, p).collect()}
    assert got == brute_conversations(rows) and got
    e = str(tmp_path / "e.parquet")
    df.limit(0).write.parquet(e)
    assert conversations.conversations(spark, e).count() == 0


def test_late_messages_over_many_batches(spark, tmp_path):
    """One file a batch: a row within the lateness is buffered and taken in, one after the watermark is dropped, places go out on the way."""
    day = lambda n: T0 + datetime.timedelta(days=n)
    schema = "message_id BIGINT, run_id STRING, index INT, observation STRING, action MAP<STRING,STRING>, sent_at TIMESTAMP_NTZ, ingested_at TIMESTAMP_NTZ"
    said, done = (lambda m, r, i, t: (m, r, i, "x", None, None, day(t))), (lambda m, r, i, t: (m, r, i, None, {"action": "go"}, None, day(t)))
    batches = [
        [said(1, "a", 0, 0), done(2, "a", 0, 0), said(3, "a", 1, 0), said(10, "b", 0, 0)],
        [said(20, "c", 0, 5), done(21, "c", 0, 5)],
        [done(4, "a", 1, 0.5), said(3, "a", 1, 5)],  # late, but not past the watermark; and a repeated delivery
        [said(30, "d", 0, 40), done(31, "d", 0, 40)],  # moves the watermark over all before
        [said(40, "e", 0, 41)],  # emits them
        [said(50, "f", 0, 90), done(51, "f", 0, 90), done(11, "b", 0, 0.5)],  # the last is past it: b stays without its reply
    ]
    folder, out = tmp_path / "in", str(tmp_path / "out")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        folder.mkdir(exist_ok=True)
        part = next((tmp_path / f"b{k}").glob("part-*.parquet"))
        part.rename(folder / f"{k}.parquet")
        import os

        os.utime(folder / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = conversations.emitted(conversations.prepared(conversations.read_files(spark, str(folder), maxFilesPerTrigger="1")))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    progress = q.recentProgress
    assert sum(p["numInputRows"] > 0 for p in progress) == len(batches)
    got = {(r["run_id"], r["turn"], r["message_id"]) for r in conversations.assembled(spark.read.schema(conversations.PLACES).parquet(out)).collect()}
    # f and e are still open: the watermark hasn't passed them
    assert got == {("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("a", 3, 4), ("c", 0, 20), ("c", 1, 21), ("d", 0, 30), ("d", 1, 31)}


# 6 ---------------------------------------------------------------------------------------------------------------


def test_repeated_actions(spark):
    acts = [
        {"action": "click", "ref": "3"}, {"action": "CLICK ", "ref": "[3]"}, {"action": "click", "ref": "3.0", "note": "again"}, {"action": "click", "ref": "4"}, {"action": "scroll", "amount": "700"}, {"action": "scroll", "amount": " 712"}, {"action": "scroll", "amount": "-700"},
        {"action": "fill", "ref": "1", "text": "quiet blanket"}, {"action": "fill", "ref": "1", "text": "Quiet  blanet"}, {"action": "fill", "ref": "1", "text": "order 12"}, {"action": "fill", "ref": "1", "text": "order 13"},
        {"action": "goto", "url": "https://a.example/x"}, {"action": "goto", "url": "HTTPS://A.example/x/?utm_source=b#top"}, {"action": "goto", "url": "https://a.example/y"}, {"action": "press", "key": "Tab", "ref": None}, {"action": "press", "key": "tab"}, None, None,
    ]
    rows = [step(i, i=i, action=a) for i, a in enumerate(acts)] + [step(1, i=1, action=acts[1]), step(100, "s", 0, action={"action": "back"}), step(101, "s", 2, action={"action": "back"}), step(102, "s", None, action={"action": "back"}), step(103, None, 0, action={"action": "back"})]
    df = frame(spark, rows)
    got = {(r["run_id"], r["first_index"], r["last_index"]): r for r in repeats.repeated_runs(df).collect()}
    assert set(got) == {("r", 0, 2), ("r", 4, 5), ("r", 7, 8), ("r", 11, 12), ("r", 14, 15)}
    assert got[("r", 0, 2)]["n_events"] == 3 and got[("r", 0, 2)]["seconds"] == 3.0
    flat = {(r["run_id"], r["index"]): r["n_events"] for r in repeats.collapsed(df).collect()}
    assert flat[("r", 0)] == 3 and ("r", 1) not in flat and flat[("r", 3)] == 1
    assert repeats.repeated_runs(df.limit(0)).count() == 0


def test_pointer_doubling_reaches_the_start_of_a_long_run(spark):
    df = spark.range(1, 70).select(F.lit("r").alias("run_id"), F.col("id").cast("int").alias("index"))
    assert {r["start"] for r in repeats.pointer_double(df).collect()} == {0}


# 7 ---------------------------------------------------------------------------------------------------------------


def test_ids_equal_the_whole_text_tokenizer(spark):
    import public_tokenizers as pt
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pt.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(4)
    long = "".join(rng.choice(["word ", "  ", "\n\n", "it's ", "1234 ", "né ", "漢字", "🏳️‍🌈", "<|endoftext|>", "\t"]) for _ in range(9000))
    texts = [None, "", " ", "plain text", "<|endoftext|>", "a" * 30000, " " * 20000, long, long[:8192], long[:8193], "x" * 9000 + " " + long]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(df).collect()}
    for k, x in enumerate(texts):
        want = t.encode(x, add_special_tokens=False).ids if x else []
        assert got[k] == want, k
        assert tokens.decode(want) == (x or "")
    for x in texts[5:]:
        assert tokens.encode_long(x, tokens.vocabulary_path(), pt.PATTERN) == t.encode(x, add_special_tokens=False).ids
    assert tokens.encoded(df.limit(0)).count() == 0
    same = spark.createDataFrame([(None, long), (7, long), (7, long), (7, "a" * 30000)], "doc_id BIGINT, text STRING").withColumn("ids", F.lit("x"))
    sizes = sorted((r["doc_id"] or 0, len(r["ids"])) for r in tokens.encoded(same).collect())
    assert sizes == sorted([(0, len(got[7])), (7, len(got[7])), (7, len(got[7])), (7, len(got[5]))])


# 8 ---------------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_packing_holds_every_item_once(sizes, capacity):
    from collections import Counter

    counts = Counter(sizes)
    patterns = packing.pack(dict(counts), capacity)
    held = Counter()
    for p, m in patterns:
        assert m > 0 and sum(s * k for s, k in p.items()) <= capacity
        for s, k in p.items():
            held[s] += k * m
    assert held == counts
    plain = sum(m for _, m in packing.best_fit(dict(counts), capacity))
    assert packing.lower_bound(counts, capacity) <= sum(m for _, m in patterns) <= plain + 1


def test_dominance_never_costs_a_container():
    """On small instances the reduction leaves the optimum reachable: fixed bins + optimum of the rest = optimum."""
    from functools import lru_cache

    def optimum(items, cap):
        items = tuple(sorted(items, reverse=True))

        @lru_cache(None)
        def go(rest, room):
            if not rest:
                return 0
            best = 1 + go(rest[1:], cap - rest[0]) if room is None else None
            if room is None:
                return best
            options = [go(rest, None)]
            for k, s in enumerate(rest):
                if s <= room:
                    options.append(go(rest[:k] + rest[k + 1 :], room - s))
            return min(options)

        return go(items, None)

    rng = random.Random(9)
    for _ in range(60):
        cap = rng.choice([10, 13, 17])
        items = [rng.randint(1, cap) for _ in range(rng.randint(1, 8))]
        fixed, left = packing.reduce_by_dominance({s: items.count(s) for s in items}, cap)
        rest = [s for s, c in left.items() for _ in range(c)]
        assert sum(m for _, m in fixed) + optimum(rest, cap) == optimum(items, cap)


def test_containers(spark):
    rows = [(k, n) for k, n in enumerate([10, 20, 50, 0, None, 130, 30, 40, 25, 25])] + [(100 + k, 7) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, n INT").withColumn("container", F.lit("x"))
    got = packing.containers(df, "doc_id", "n", 50)
    used = {r["container"]: r["u"] for r in got.groupBy("container").agg(F.sum("n_tokens").alias("u")).collect()}
    assert max(used.values()) <= 50 and sum(used.values()) == sum(n or 0 for _, n in rows)
    assert sorted(r["n_tokens"] for r in got.where("doc_id = 5").collect()) == [30, 50, 50]
    assert got.count() == len(rows) + 2 and sorted(used) == list(range(len(used)))
    assert packing.containers(df.limit(0), "doc_id", "n", 50).count() == 0


# 9 ---------------------------------------------------------------------------------------------------------------

NICE = ["The ferry leaves at {n} in the morning.", "Sort the table by date and open row {n}.", "The report counts {n} hateful messages and names none.", "Rats and other vermin were driven out of cellar {n}.", "I made a stupid mistake in step {n} and felt like a fool."]
RUDE = ["You are a worthless idiot and nobody wants you here.", "Shut your mouth, you pathetic loser.", "Watch free porn videos, uncensored sex cams around the clock.", "People like that are vermin and ought to be driven out."]
HIDDEN = ["You are a w0rthless 1d10t and nobody wants you here.", "Shut your mouth, you pathetic l.o.s.e.r.", "Watch free роrn videos, uncensored sex cams around the clock.", "SHUT YOUR MOUTH, YOU PATHETIC LOOOSER."]


def corpus(seed, n, rude):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        s = [rng.choice(NICE).format(n=rng.randint(1, 99)) for _ in range(4)]
        if k in rude:
            s.insert(rng.randint(0, 4), rng.choice(RUDE))
        out.append(" ".join(s))
    return out


def test_abuse_is_found_through_disguises(spark):
    texts = corpus(1, 300, set(range(0, 60)))
    docs = [(k, "s" if k % 2 else None, t) for k, t in enumerate(texts)]
    docs += [(1000 + k, "h", f"The ferry leaves at nine. {t}") for k, t in enumerate(HIDDEN)] + [(2000, "h", None), (2001, "h", ""), (2002, "h", " ​")]
    labels = [(k, "a", 1) for k in range(0, 40)] + [(k, "a", 0) for k in range(60, 160)] + [(3, "b", 0), (3, "c", 1), (None, "a", 1), (70, "b", None)]
    d = spark.createDataFrame(docs, "doc_id BIGINT, source STRING, text STRING")
    lab = spark.createDataFrame(labels, "doc_id BIGINT, annotator STRING, label INT")
    found = {r["doc_id"] for r in abuse.flagged(d, lab).collect()}
    rude = set(range(60)) | {1000, 1001, 1002, 1003}
    assert len(found & rude) >= 0.95 * len(rude) and len(found - rude) <= 2
    rate = {r["source"]: r for r in abuse.rates(d, lab).collect()}
    assert rate["h"]["documents"] == 7 and rate["h"]["flagged"] == 4
    assert abuse.flagged(d, lab.limit(0)).count() == 0 and abuse.flagged(d.limit(0), lab).count() == 0


def test_every_unlabelled_document_enters_the_risk(spark, monkeypatch):
    texts = [f"Row {k} of the table.\nThe ferry leaves at nine." for k in range(4500)]
    pos, neg = ["You are a worthless idiot and nobody wants you here."] * 3, ["The ferry leaves at ten."]
    df, held = spark.createDataFrame([(t,) for t in texts], "text STRING"), abuse.Held(texts)
    w = np.random.default_rng(1).normal(size=abuse.MASK + 1)
    for spread in (abuse.Spread(df), abuse.Spread(df, held=0)):
        assert (len(spread), spread.docs) == (len(held), held.docs) == (9000, 4500) and np.allclose(spread.seen(), held.seen())
        for a, b in zip(spread.share(w, -1.0), held.share(w, -1.0)):
            assert np.allclose(a, b, rtol=1e-5)  # the vectors travel in 32 bits
    docs = spark.createDataFrame([*((k, "s", t) for k, t in enumerate(texts)), *((10_000 + k, "s", t) for k, t in enumerate(pos + neg))], "doc_id BIGINT, source STRING, text STRING")
    lab = spark.createDataFrame([*((10_000 + k, "a", 1) for k in range(3)), (10_003, "a", 0)], "doc_id BIGINT, annotator STRING, label INT")
    seen = []
    monkeypatch.setattr(abuse, "learn", lambda p, n, u: seen.append((len(p), len(n), u.count())))
    abuse.fitted(docs, lab)
    assert seen == [(3, 1, 4500)]


def test_words_read_through_disguises():
    one = lambda t: abuse.read(t)[0][0]
    assert one("1d10t") == one("Idioot") == one("ІDІОТ") == one("idiot")
    assert abuse.read("m***n") == (["m*n", abuse.STARRED], [abuse.STARRED]) and one("12_000") == "\x01number"


def test_no_word_of_a_long_sentence_is_lost():
    words = ["x" * 700, *"you are a worthless idiot and nobody wants you here today my dear old friend of the mill by the river".split()]
    got = " ".join(abuse.sentences(" ".join(words)))
    assert all(w in got for w in words[1:]) and got.count("x") >= 700
    assert max(map(len, abuse.sentences("y" * 5000 + " end"))) <= abuse.LONGEST and sum(map(len, abuse.sentences("y" * 5000))) == 5000


# all -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_on_the_smallest_tables(spark, name):
    df = queries.queries()[name](spark, DATA)
    rows = df.collect()
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)
