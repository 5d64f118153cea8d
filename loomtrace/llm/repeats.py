"""Problem 6: runs of the same or nearly the same action at consecutive indexes, collapsed by pointer doubling.

Each event that repeats its predecessor points to it; every round a self-join replaces a pointer by the pointer's
pointer, so after ceil(log2(length of the longest run)) rounds all pointers reach the start of their run. Joins are
on (run, index), never on the run alone: a run that holds a third of all rows spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.session import cut_lineage

#: Entries of an action that only comment on it.
REMARKS = ("note", "rationale")
#: Share of the larger scroll amount by which another may differ and still be the same scroll.
SCROLL_TOLERANCE = 0.1
#: Texts shorter than this have no room for a slip of one letter.
SLIP_LENGTH = 4
#: Query parameters of an address that only say where the visitor came from.
TRACKING = "utm_[a-z]+|gclid|fbclid|msclkid|mc_[a-z]+|_ga|ref_src"


def plain(col: Column) -> Column:
    """Case, spacing, closing punctuation and the format of numbers removed: ' [12.0]' and '12' become equal."""
    x = F.lower(F.regexp_replace(col, r"[\p{Z}\p{C}]+", " "))
    x = F.regexp_replace(x, r"(?<=\d)[,'’](?=\d{3}(?!\d))", "")
    x = F.regexp_replace(x, r"(?<![\d.])(\d+)\.0+(?![\d.])", "$1")
    x = F.regexp_replace(x, r"(?<![\d.])0+(?=\d)", "")
    return F.trim(F.regexp_replace(F.trim(x), r"[\s.!;,]+$", ""))


def plain_ref(col: Column) -> Column:
    return plain(F.regexp_replace(col, r"[\[\]()#\s]", ""))


def plain_url(col: Column) -> Column:
    """An address without the parts that leave the page the same: case of scheme and host, default port, fragment, tracking, last slash."""
    x = F.regexp_replace(F.trim(col), r"#.*$", "")
    x = F.regexp_replace(x, rf"(?i)(?<=[?&])(?:{TRACKING})=[^&]*(?:&|$)", "")
    x = F.regexp_replace(x, r"[?&]+$", "")
    head = F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    tail = F.regexp_replace(x, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    head = F.regexp_replace(F.regexp_replace(head, r"^http://", "https://"), r":(80|443)$", "")
    return F.concat(head, F.regexp_replace(F.regexp_replace(tail, r"/+(?=\?|$)", ""), r"/(?:index\.html?)?$", ""))


def canonical(action: Column) -> list[Column]:
    """The action taken apart: kind and what must be equal (`rest`), and what may differ a little (`words`, `amount`)."""
    a = F.map_filter(action, lambda k, v: v.isNotNull() & ~k.isin(*REMARKS))
    get = lambda k: F.element_at(a, F.lit(k))
    free = F.map_filter(a, lambda k, v: ~k.isin("action", "text", "answer", "amount", "ref", "url"))
    signed = F.regexp_replace(get("amount"), r"[\s,'+\[\]]|px", "").try_cast("double")
    rest = F.concat_ws(
        "\u0001",
        F.array_sort(
            F.concat(
                F.transform(F.map_entries(free), lambda e: F.concat(F.trim(F.lower(e["key"])), F.lit("="), plain(e["value"]))),
                F.array_compact(
                    F.array(
                        F.concat(F.lit("ref="), plain_ref(get("ref"))),
                        F.concat(F.lit("url="), plain_url(get("url"))),
                        F.when(get("text").isNotNull(), F.lit("text")),
                        F.when(get("answer").isNotNull(), F.lit("answer")),
                        F.when(get("amount").isNotNull() & signed.isNull(), F.concat(F.lit("amount="), plain(get("amount")))),
                        F.when(signed.isNotNull(), F.lit("amount")),
                    )
                ),
            )
        ),
    )
    words = F.concat_ws("\u0001", plain(get("text")), plain(get("answer")))
    return [plain(get("action")).alias("kind"), rest.alias("rest"), words.alias("words"), signed.alias("amount")]


def near(a: str, b: str) -> Column:
    """Whether two taken-apart actions are the same or nearly so. Digits must agree, letters may differ by one slip."""
    c = F.col
    wa, wb = c(f"{a}.words"), c(f"{b}.words")
    digits = lambda w: F.regexp_replace(w, r"\D", "")
    slip = (F.least(F.length(wa), F.length(wb)) >= SLIP_LENGTH) & (digits(wa) == digits(wb)) & (F.levenshtein(wa, wb, 1) >= 0)
    x, y = c(f"{a}.amount"), c(f"{b}.amount")
    close = (x.isNull() & y.isNull()) | ((F.signum(x) == F.signum(y)) & (F.abs(x - y) <= SCROLL_TOLERANCE * F.greatest(F.abs(x), F.abs(y))))
    return (c(f"{a}.kind") == c(f"{b}.kind")) & (c(f"{a}.kind") != "") & (c(f"{a}.rest") == c(f"{b}.rest")) & ((wa == wb) | slip) & F.coalesce(close, F.lit(False))


def events(steps: DataFrame) -> DataFrame:
    """One row for each step with its taken-apart action. Rows without run, index or kind of action start no series and join none."""
    return (
        steps.where("run_id IS NOT NULL AND index IS NOT NULL AND action IS NOT NULL")
        .select("step_id", "run_id", "index", "started_at", "ended_at", *canonical(F.col("action")))
        .where("kind IS NOT NULL")
        .groupBy("run_id", "index")
        .agg(*[F.first(c).alias(c) for c in ("step_id", "started_at", "ended_at", "kind", "rest", "words", "amount")])
    )


def links(ev: DataFrame) -> DataFrame:
    """(run_id, index) of each event that repeats the one before: it is near its predecessor, or both are near the one before that."""
    p = ev.select("run_id", (F.col("index") + 1).alias("index"), F.struct("kind", "rest", "words", "amount").alias("p"))
    q = ev.select("run_id", (F.col("index") + 2).alias("index"), F.struct("kind", "rest", "words", "amount").alias("q"))
    e = ev.select("run_id", "index", F.struct("kind", "rest", "words", "amount").alias("e"))
    both = e.join(p, ["run_id", "index"]).join(q, ["run_id", "index"], "left")
    return both.where(near("e", "p") | F.coalesce(near("e", "q") & near("p", "q"), F.lit(False))).select("run_id", "index")


def pointer_double(linked: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(run_id, index, start) for each linked event. A round doubles the distance all pointers reach; events without a
    link are starts and stay out of the table. Rounds end when none moved; that is one number counted per round."""
    at = cut_lineage(linked.select("run_id", "index", (F.col("index") - 1).alias("start")))
    for _ in range(max_rounds):
        far = at.select("run_id", F.col("index").alias("start"), F.col("start").alias("further"))
        step = at.join(far, ["run_id", "start"], "left")
        at = cut_lineage(step.select("run_id", "index", F.coalesce("further", "start").alias("start"), F.col("further").isNotNull().alias("moved")))
        if at.where("moved").limit(1).count() == 0:
            break
    return at.select("run_id", "index", "start")


def _series(ev: DataFrame, at: DataFrame) -> DataFrame:
    """The longest series of two or more events, from the events and the start of each linked one."""
    ends = at.groupBy("run_id", F.col("start").alias("first_index")).agg(F.max("index").alias("last_index"))
    head = ev.select("run_id", F.col("index").alias("first_index"), "kind", F.col("started_at").alias("began_at"))
    tail = ev.select("run_id", F.col("index").alias("last_index"), "ended_at")
    return (
        ends.join(head, ["run_id", "first_index"])
        .join(tail, ["run_id", "last_index"])
        .select(
            "run_id", "first_index", "last_index", (F.col("last_index") - F.col("first_index") + 1).alias("n_events"), "kind", "began_at",
            (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("began_at").cast("timestamp"))).cast("double").__truediv__(1e6).alias("seconds"),
        )
    )


def repeated_runs(steps: DataFrame) -> DataFrame:
    """run_id, first_index, last_index, n_events, kind, began_at, seconds: each longest series of two or more events.

    Null or empty actions belong to no series; a lost step ends one; repeated deliveries of a step count once; a step
    without times gives a null duration; an empty table gives no rows; further columns are ignored.
    """
    ev = cut_lineage(events(steps))
    return _series(ev, pointer_double(links(ev)))


def collapsed(steps: DataFrame) -> DataFrame:
    """run_id, index, n_events, seconds: the sequence with each series replaced by its first event, the rest as they were."""
    ev = cut_lineage(events(steps))
    at = pointer_double(links(ev))
    kept = ev.select("run_id", "index", "kind").join(at.select("run_id", "index"), ["run_id", "index"], "left_anti")
    return kept.join(_series(ev, at).select("run_id", F.col("first_index").alias("index"), "n_events", "seconds"), ["run_id", "index"], "left").select(
        "run_id", "index", "kind", F.coalesce("n_events", F.lit(1)).alias("n_events"), "seconds"
    )
