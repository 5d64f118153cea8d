"""Problem 2: the main body of a page told from the site's frame, line by line, by the density of text against tags.

Method. A page's lines stream through the standard library's HTML parser, whose events count the tags that are left in
the text. Plain page text has lost its tags in rendering, so their traces count in their place: a line that recurs on
other pages of its host, or on other hosts, was put there by a template; a line that is, or begins with, the title of
another page of the host is a link; separators part the entries of a menu. Every line gets the logarithm of its
text-to-tag ratio, a Gaussian smooths the ratios along the page (blank lines take up room, so blocks keep apart), and
two-means clustering parts the lines into the dense and the thin: the body and the frame. Nothing else decides.

Scale. Recurrence is counted over all pages with partial aggregations, on hashes of lines. What is kept of it is bounded
by the lines that recur (at least LEVELS[0] of a host's pages, or of the hosts) and the titles; up to
BROADCAST_ENTRIES of these, counted first, go to the workers as two sorted arrays, beyond that they are joined to the
pages by a salted key, so a host with a third of all rows spreads over SALT times as many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import is_shown
from loomtrace.session import cut_lineage

#: Shares of a host's pages, and of all hosts, that part how recurrent a line is into four levels.
LEVELS, HOST_LEVELS = (0.03, 0.1, 0.3), (0.05, 0.2, 0.5)
#: Pages, or hosts, that are added to the count before a share is taken: a line on both pages of a host isn't yet recurrent on all.
DOUBT = 2
#: Standard deviation of the Gaussian, in lines, and how far it reaches.
SIGMA, REACH = 1.2, 4
#: Where two-means begins, and how many lines each of these two points stands for: a page all of one kind isn't torn apart.
ANCHORS, ANCHOR_LINES = (-5.0, 5.0), 10.0
#: Entries (9 bytes each) up to which the recurrent lines are broadcast; beyond, a salted join.
BROADCAST_ENTRIES = 2_000_000
SALT = 16

#: What each trace of a tag, or of text, adds to the logarithm of a line's text-to-tag ratio: round figures near those of
#: a logistic regression over the smoothed traces of the pages at sf0.1.
WEIGHTS = {
    "one": -6.0, "host1": -3.3, "host2": -0.8, "host3": -2.8, "web1": 2.3, "web2": 4.6, "web3": 8.1, "host_text": -0.6, "web_text": -2.5, "web_sentence": 3.0, "host_sentence": -6.8, "text": 1.8, "sentence": 2.5, "separators": -1.8, "titles": -5.6, "begins_with_title": -30.0,
    "opens_block": 0.2, "opens_block_short": -4.7, "above_heading": -6.8, "heading": 14.0, "table": 10.5, "tags": -0.5,
}
_WEIGHTS = np.array(list(WEIGHTS.values()))
_ABOVE, _HEADING = (list(WEIGHTS).index(n) for n in ("above_heading", "heading"))

SEPARATORS = r"\s*[|›»>·•\t]\s*|\s+/\s+|\s{2,}"
TITLE_SEPARATORS = r"\s+[|–—-]\s+|\s+::\s+|\s+·\s+"
#: A colon after which a teaser begins.
COLON = ": "
EDGES = " \t\r\x0b\x0c"
_SEP = re.compile(SEPARATORS)
_TITLE_SEP = re.compile(TITLE_SEPARATORS)
_DIGITS = re.compile(r"[0-9]+")
_ENDS = frozenset(".!?…。！？”\"")
TITLE_BIT = 16


class Events(HTMLParser):
    """Counts the tag events and the text of one line, as the parser streams them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags = self.text = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1

    def handle_endtag(self, tag):
        self.tags += 1

    def handle_data(self, data):
        self.text += len(data.strip())


def xxhash64(data: bytes) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(data, seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def line_key(line: str) -> int:
    """The key under which a line or a part of one is counted: digits masked, spaces at the ends dropped; equals xxhash64 in the JVM."""
    return xxhash64(_DIGITS.sub("0", line.strip(EDGES)).encode("utf-8", "replace"))


class Line:
    """What a line shows by itself."""

    __slots__ = ("key", "parts", "weights", "head", "text", "sentence", "separators", "table", "tags")

    def __init__(self, s: str) -> None:
        self.tags, n = 0, len(s)
        if "<" in s:
            e = Events()
            e.feed(s)
            self.tags, n = e.tags, max(1, e.text) if e.tags else len(s)
        self.key, self.text, self.sentence, self.table = line_key(s), float(np.log(n)), s[-1] in _ENDS, "\t" in s
        parts = [p for p in _SEP.split(s) if p] or [s]
        self.separators = len(parts) - 1
        size = sum(map(len, parts))
        self.parts, self.weights = [line_key(p) for p in parts] if self.separators else [self.key], [len(p) / size for p in parts]
        self.head = line_key(parts[0][: parts[0].index(COLON)]) if COLON in parts[0] else None


_lines: dict[str, Line | None] = {}


def line_of(s: str) -> Line | None:
    """The Line of a stripped line; None if it shows nothing. Lines of ordinary length are kept for the worker: 100,000 of at most 400 characters."""
    if len(s) > 400:
        return Line(s) if is_shown(s) else None
    if s in _lines:
        return _lines[s]
    if len(_lines) >= 100_000:
        _lines.clear()
    got = _lines[s] = Line(s) if is_shown(s) else None
    return got


Codes = Callable[[np.ndarray], np.ndarray]


class Recurrence:
    """The codes of (host, line) keys, from two sorted arrays."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray) -> None:
        self.keys, self.codes = keys, codes

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.codes[at], 0).astype(np.int64)


def traces(pages: list[tuple[str, str | None, int | None]], codes: Codes) -> tuple[list[list[Line | None]], list[np.ndarray], list[np.ndarray]]:
    """For each page (text, title, hash of its host): its lines, how recurrent each is (the code of the line), and one row of WEIGHTS' traces for each line."""
    read, wanted = [], []
    for text, title, host in pages:
        lines = [line_of(x.strip()) for x in text.split("\n")]
        own = {line_key(p) for p in (title or "", *_TITLE_SEP.split(title or "")) if p}
        h = 0 if host is None else host
        for ln in lines:
            if ln is not None:
                wanted += [k ^ h for k in ln.parts]
                wanted.append(ln.key ^ h)
                wanted.append((ln.key if ln.head is None else ln.head) ^ h)
        read.append((lines, own, host))
    got = codes(np.array(wanted, np.int64))
    all_lines, all_codes, rows, at = [], [], [], 0
    for lines, own, host in read:
        x, c = np.zeros((len(lines), len(WEIGHTS))), np.zeros(len(lines), np.int64)
        level = []
        for i, ln in enumerate(lines):
            if ln is None:
                level.append((0, 0))
                continue
            n = len(ln.parts)
            part, c[i], head = got[at : at + n], 0 if host is None else got[at + n], got[at + n + 1]
            at += n + 2
            if host is None:
                part, head = part * 0, 0
            on_host, on_web = int(c[i]) & 3, int(c[i]) >> 2 & 3
            level.append((on_host, on_web))
            titles = sum(w for k, w, p in zip(ln.parts, ln.weights, part) if p & TITLE_BIT and k not in own)
            opens = i == 0 or lines[i - 1] is None
            x[i] = (
                1, on_host >= 1, on_host >= 2, on_host >= 3, on_web >= 1, on_web >= 2, on_web >= 3, ln.text if on_host >= 2 else 0, ln.text if on_web >= 2 else 0, ln.sentence and on_web >= 2, ln.sentence and on_host >= 2, ln.text, ln.sentence, ln.separators, titles, ln.head is not None and bool(head & TITLE_BIT),
                opens, opens and not ln.sentence, 0, 0, ln.table, np.log1p(ln.tags),
            )
        # the page's own heading: the first line that is its title, or a part of it that isn't the site's name on every page
        heading = next((i for i, ln in enumerate(lines) if ln is not None and ln.key in own and level[i][0] < 3), None)
        if heading is not None:
            x[:heading, _ABOVE] = 1
            x[heading, _HEADING] = 1
        all_lines.append(lines)
        all_codes.append(c)
        rows.append(x)
    return all_lines, all_codes, rows


def smoothed(rows: list[np.ndarray], shown: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the smoothed log ratio of all lines of all pages, 1 where a line shows something, the page of each), pages one after the other with a gap that the Gaussian cannot cross."""
    lengths = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(lengths + REACH)[:-1]])
    total = int(lengths.sum()) + REACH * len(rows)
    flat, mask = np.zeros(total), np.zeros(total)
    for s, r, m in zip(starts, rows, shown):
        flat[s : s + len(r)] = (r @ _WEIGHTS) * m
        mask[s : s + len(r)] = m
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    spread = lambda a: np.convolve(a, kernel)[REACH : REACH + len(a)]
    return spread(flat) / np.maximum(spread(mask), 1e-9) * mask, mask, np.repeat(np.arange(len(rows)), lengths + REACH)


def clustered(smooth: np.ndarray, mask: np.ndarray, page: np.ndarray, n: int) -> np.ndarray:
    """Two-means on the smoothed ratios of each page: True where a line belongs to the dense cluster."""
    low, high = np.full(n, ANCHORS[0]), np.full(n, ANCHORS[1])
    for _ in range(8):
        up = (smooth >= ((low + high) / 2)[page]) & (mask > 0)
        down = ~up & (mask > 0)
        high = (np.bincount(page, smooth * up, n) + ANCHORS[1] * ANCHOR_LINES) / (np.bincount(page, up, n) + ANCHOR_LINES)
        low = (np.bincount(page, smooth * down, n) + ANCHORS[0] * ANCHOR_LINES) / (np.bincount(page, down, n) + ANCHOR_LINES)
    return smooth >= ((low + high) / 2)[page]


def frame_lines(pages: list[tuple[str, str | None, int | None]], codes: Codes) -> tuple[list[list[int]], list[list[Line | None]], list[np.ndarray]]:
    """(the numbers of the frame lines, the lines, the lines' codes) of each page (text, title, hash of its host)."""
    if not pages:
        return [], [], []
    lines, seen, rows = traces(pages, codes)
    shown = [np.array([ln is not None for ln in p], float) for p in lines]
    smooth, mask, page = smoothed(rows, shown)
    dense = clustered(smooth, mask, page, len(pages))
    out, at = [], 0
    for s in shown:
        out.append(np.flatnonzero((s > 0) & ~dense[at : at + len(s)]).tolist())
        at += len(s) + REACH
    return out, lines, seen


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _masked(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]+", "0")


def _hashes(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.xxhash64(F.btrim(x, F.lit(EDGES))))


def recurrences(steps: DataFrame) -> DataFrame:
    """entry, code: for each (host, line) that recurs, and for each title of a host's pages, the hash of both and how
    recurrent it is: the level among the host's pages (0-3), 4 times that among the hosts, 16 for a title."""
    o = F.col("observation")
    page = steps.where("observation.text IS NOT NULL AND observation.url IS NOT NULL").select(
        F.xxhash64(host_of(o["url"])).alias("host"), F.xxhash64(F.regexp_replace(o["url"], "[?#].*$", "")).alias("page"), _hashes(F.split(_masked(o["text"]), "\n")).alias("keys"),
        F.when(o["title"].isNotNull(), _hashes(F.array_append(F.split(_masked(o["title"]), TITLE_SEPARATORS), _masked(o["title"])))).alias("titles"),
    )
    lines = page.select("host", "page", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    pages = page.groupBy("host").agg(F.approx_count_distinct("page", 0.02).alias("pages"))
    on = lines.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).join(pages, "host")
    on = cut_lineage(on.select("host", "key", ((F.col("n") - 1) / (F.col("pages") + DOUBT)).alias("share")))
    hosts = on.select("host").distinct().count()
    web = on.groupBy("key").agg(F.count(F.lit(1)).alias("hosts")).select("key", ((F.col("hosts") - 1) / (hosts + DOUBT)).alias("web")).where(F.col("web") > HOST_LEVELS[0])
    level = lambda c, bounds: sum((F.coalesce(F.col(c), F.lit(0.0)) > b).cast("int") for b in bounds)
    lined = on.join(web, "key", "left").select("host", "key", (level("share", LEVELS) + 4 * level("web", HOST_LEVELS)).alias("code")).where("code > 0")
    titled = page.select("host", F.explode("titles").alias("key")).distinct().withColumn("code", F.lit(TITLE_BIT))
    return lined.unionByName(titled).select(F.col("host").bitwiseXOR(F.col("key")).alias("entry"), "code").groupBy("entry").agg(F.sum("code").cast("int").alias("code"))


def with_pages(steps: DataFrame, fn: Callable[[pa.RecordBatch, list[Codes]], pa.RecordBatch], schema: str, *more: Column, broadcast: int = BROADCAST_ENTRIES) -> DataFrame:
    """fn over Arrow batches of step_id, text, title, host (its hash) and `more`, with the codes of recurrent lines."""
    entries = cut_lineage(recurrences(steps))
    o = F.col("observation")
    host = F.xxhash64(F.nullif(host_of(o["url"]), F.lit("")))
    rows = steps.where("step_id IS NOT NULL").select(F.col("step_id").cast("bigint"), o["text"].alias("text"), o["title"].alias("title"), F.when(o["url"].isNotNull(), host).alias("host"), *more)
    if entries.limit(broadcast + 1).count() <= broadcast:
        t = entries.toArrow()  # at most `broadcast` rows of 12 bytes
        keys, codes = t.column(0).to_numpy(), t.column(1).to_numpy().astype(np.uint8)
        order = np.argsort(keys)
        shared = steps.sparkSession.sparkContext.broadcast((keys[order], codes[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Recurrence(*shared.value)
            for b in batches:
                yield fn(b, known)

        return rows.mapInArrow(run, schema)
    # one row for each step, then its candidates joined to the entries, salted: a line of a host with a third of all rows is no hot key
    rows = rows.dropDuplicates(["step_id"])
    parts = F.concat(*[_hashes(F.split(_masked(F.col("text")), at)) for at in ("\n", f"\n|{SEPARATORS}", f"\n|{COLON}|{SEPARATORS}")])
    wanted = rows.where("host IS NOT NULL AND text IS NOT NULL").select("step_id", "host", F.explode(F.array_distinct(parts)).alias("key"))
    wanted = wanted.select("step_id", F.col("key").bitwiseXOR(F.col("host")).alias("entry"), F.pmod(F.xxhash64("step_id"), F.lit(SALT)).alias("salt"))
    salted = entries.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    met = wanted.join(salted, ["entry", "salt"]).groupBy("step_id").agg(F.collect_list("entry").alias("entries"), F.collect_list("code").alias("codes"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("entries").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            codes = b.column("codes").flatten().to_numpy(zero_copy_only=False)
            keys, first = np.unique(keys, return_index=True)
            yield fn(b.drop_columns(["entries", "codes"]), Recurrence(keys, codes[first]))

    return rows.join(met, "step_id", "left").mapInArrow(run_joined, schema)


def each_page(b: pa.RecordBatch, codes: Codes) -> tuple[list[tuple], list[int], tuple]:
    """(the different pages of a batch, which of them each row has, what frame_lines says of them)."""
    done: dict[tuple, int] = {}
    which = [done.setdefault(k, len(done)) for k in zip(b.column("text").to_pylist(), b.column("title").to_pylist(), b.column("host").to_pylist())]
    pages = list(done)
    some = [k for k, p in enumerate(pages) if p[0]]
    frames, lines, seen = frame_lines([pages[k] for k in some], codes)
    full: list[tuple] = [([], [], np.empty(0, np.int64))] * len(pages)
    for k, *got in zip(some, frames, lines, seen):
        full[k] = tuple(got)
    return pages, which, full


def frame_rows(steps: DataFrame, broadcast: int = BROADCAST_ENTRIES) -> DataFrame:
    """step_id, line_no: one row for each frame line with visible characters. Null and empty texts have no lines; a page
    without an address is judged by what it shows alone; a step delivered repeatedly counts once; further columns are ignored."""

    def run(b: pa.RecordBatch, codes: Codes) -> pa.RecordBatch:
        _, which, got = each_page(b, codes)
        return pa.RecordBatch.from_arrays([b.column("step_id"), pa.array([got[k][0] for k in which], pa.list_(pa.int32()))], names=["step_id", "lines"])

    numbers = with_pages(steps, run, "step_id BIGINT, lines ARRAY<INT>", broadcast=broadcast)
    return numbers.groupBy("step_id").agg(F.first("lines").alias("lines")).select("step_id", F.explode("lines").alias("line_no"))


def main_bodies(steps: DataFrame, broadcast: int = BROADCAST_ENTRIES) -> DataFrame:
    """step_id, body, n_lines: the main body of each step's page and how many lines it kept (blank ones too); null where
    the text is null, empty where all is frame. The bodies are cut where the pages are read; no text is shuffled but they."""

    def run(b: pa.RecordBatch, codes: Codes) -> pa.RecordBatch:
        pages, which, got = each_page(b, codes)
        bodies, counts = [], []
        for (text, _, _), (frame, _, _) in zip(pages, got):
            out = set(frame)
            kept = None if text is None else [x for i, x in enumerate(text.split("\n")) if i not in out]
            bodies.append(None if kept is None else "\n".join(kept))
            counts.append(None if kept is None else len(kept))
        return pa.RecordBatch.from_arrays([b.column("step_id"), pa.array([bodies[k] for k in which], pa.string()), pa.array([counts[k] for k in which], pa.int32())], names=["step_id", "body", "n_lines"])

    return with_pages(steps, run, "step_id BIGINT, body STRING, n_lines INT", broadcast=broadcast).dropDuplicates(["step_id"])
