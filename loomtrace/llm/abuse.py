"""Problem 9: abusive, hateful or sexual passages, found by non-negative positive-unlabelled learning.

A linear classifier over the sentences of documents is fitted with numpy from the documents that annotators confirmed
and from unlabelled ones. The risk is that of nnPU: with the share `pi` of positive sentences,
``pi R_p(+) + max(0, R_u(-) - pi R_p(-))``, whose second term is turned around where it falls below zero. A confirmed
document says only that some sentence of it is abusive, so the positives are chosen anew in each round: the sentences
of a confirmed document that the last model finds likeliest, at first those that no cleared document shares words with.

Words are read through their disguises first: look-alike letters, digits and signs for letters, letters set apart,
repeated or replaced by stars, invisible characters. No list of words takes part: what is abusive is learned. Fitting
uses at most MAX_LABELLED labelled documents of at most MAX_CHARS characters, chosen by a hash of the key, and all other
documents as unlabelled ones: their part of the risk, of its gradient and of the prior is summed over the cluster, each
different sentence once with its count, at SNAPSHOTS points of a round; between two of them the change since the last is
read off the cleared sentences (variance-reduced gradients). Scoring covers every document where it is read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.session import cut_lineage

#: Bounds of the labelled documents that are fitted on, and of the characters of each; the unlabelled ones have none.
MAX_LABELLED, MAX_CHARS = 6000, 8000
#: Partitions of the unlabelled sentences at most: the driver gets a vector of 2**BITS from each in a pass.
PARTS = 64
#: Passes over all unlabelled sentences in a round, closer to each other at its beginning.
SNAPSHOTS, SPACING = 20, 2.0
#: Features of the different unlabelled sentences, counted first, up to which they are summed on the driver; beyond, on the cluster. The sums are the same.
HELD = 12_000_000
#: Hashed features, rounds of choosing positives, steps of the optimiser in each.
BITS, ROUNDS, STEPS = 18, 3, 120
#: The prior to begin with, as a share of what the labelled documents, which are picked, would make it; it never falls below.
PRIOR = 0.25
#: Weight of a cleared sentence that the model takes for abusive; below 1, since annotators miss some.
CLEARED = 0.3
#: How much more positives weigh in the first third of the steps: the sigmoid's slope vanishes on those that common words drag down first.
WARM = 2.0
#: Occurrences added to those of a feature outside the confirmed documents: a string seen once is no evidence yet.
SMOOTH = 5.0
#: Share of its features that several positives have, from which a cleared sentence counts as unlabelled.
ALIKE = 0.6
#: Words of the overlapping windows that a longer sentence is read in, and characters of one (a longer one is read in parts): an insult between sentences that don't end isn't drowned.
WINDOW, LONGEST = 16, 600
#: Words on either side of a marked one that are also read alone.
NEAR = 6

# Letters that look alike, digits and signs that stand for letters.
LOOKALIKE = str.maketrans("аеорсухіѕјкмнтвԁɡһոαεοριυκντ", "aeopcyxisjkmhtbdghnaeopiukvt")
LEET_LETTERS = str.maketrans("013457@$!|", "oieastasii")

_INVISIBLE = re.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"”’)]*\s+|\n+|(?<=[。！？])")
_TOKEN = re.compile(r"[^\W_](?:[^\s,;:\"“”()\[\]{}<>|/\\?]*[^\s,;:.!?\"“”()\[\]{}<>|/\\-])?|[@$][^\W_][^\s,;:.?\"“”()]*")
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_]([ ._\-*]))(?:[^\W\d_]\1)+[^\W\d_]+(?![^\W_])|(?<![^\W_])(?:[^\W\d_][._-]){2,}[^\W\d_]+")
_RUN = re.compile(r"(.)\1+")
_STARRED = re.compile(r"[^\W\d_]+\*+[^\W\d_]*|[^\W\d_]*\*+[^\W\d_]+")
_LEETED = re.compile(r"(?=.*[^\W\d_])(?=.*[013457@$!|])[^\W_@$!|]?[\w@$!|]+")


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c))


def skeleton(word: str) -> str:
    """A word without accents and doubled letters, so that 'Idioot' and 'idiot' are one."""
    return _RUN.sub(r"\1", _fold(word))


STARRED, LEET = "\x01starred", "\x01leet"


def read(token: str) -> tuple[list[str], list[str]]:
    """(the words a token may stand for, marks of its disguise), lower case and undisguised. Of a starred word the letters at its ends are left."""
    t = token.casefold()
    if "*" in t and _STARRED.fullmatch(t):
        return [f"{t[0]}*{t[-1]}", STARRED], [STARRED]
    plain = _fold(t)
    if not plain.isascii():
        plain = plain.translate(LOOKALIKE)
    marks: list[str] = []
    if not plain.isalpha() and len(plain) >= 4 and _LEETED.fullmatch(plain) and sum(c.isalpha() for c in plain) * 3 >= len(plain):
        word = skeleton(plain.translate(LEET_LETTERS))
        if word.isalpha():
            plain, marks = word, [LEET]
    plain = re.sub(r"[^\w]", "", plain)
    if any(c.isdigit() for c in plain):
        return ["\x01number"], marks
    return [_RUN.sub(r"\1", plain)], marks


_known: dict[str, tuple[list[int], list[int]]] = {}
MASK = (1 << BITS) - 1
_NAME = [0x5EED]


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) & 0xFFFFFFFF



def known(token: str) -> tuple[list[int], list[int]]:
    """Hashes of a token's words and marks, kept for the worker: 300,000 tokens of at most 40 characters."""
    k = _known.get(token)
    if k is None:
        words, marks = read(token)
        k = ([_hash(w) for w in words], [_hash(m) for m in marks])
        if len(token) <= 40:
            if len(_known) >= 300_000:
                _known.clear()
            _known[token] = k
    return k


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, undisguised as far as whole sentences can be."""
    if not text:
        return []
    t = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    out = []
    for s in _SENTENCE.split(t):
        s = s.strip()
        if not s:
            continue
        words = s.split()
        if len(words) > WINDOW + WINDOW // 2:
            parts = [" ".join(words[k : k + WINDOW]) for k in range(0, len(words) - WINDOW // 2, WINDOW // 2)]
        else:
            parts = [s]
        for p in parts:
            out += [p[k : k + LONGEST] for k in range(0, len(p), LONGEST)] if len(p) > LONGEST else [p]
    return out


def words_of(s: str) -> tuple[list[int], list[int], list[int]]:
    """(hashes of the words of a sentence, hashes of their marks, places of marked words)."""
    s = _APART.sub(lambda m: re.sub(r"[ ._\-*]", "", m.group(0)), s)
    words: list[int] = []
    marks: list[int] = []
    places: list[int] = []
    for k, token in enumerate(_TOKEN.findall(s)):
        w, m = known(token)
        if m:
            places.append(len(words))
            marks += m
        elif k and token[0].isupper() and token[1:].islower():
            w = _NAME
        words += w
    return words, marks, places


def features(words: list[int], marks: list[int]) -> list[int]:
    """Hashed words, neighbouring pairs, marks, and marks with the first words."""
    out = [w & MASK for w in words]
    out += [(a * 31 + b * 17 + 7) & MASK for a, b in zip(words, words[1:])]
    out += [(a * 131 + b * 37 + 11) & MASK for a, b in zip(words, words[2:])]
    for m in marks:
        out.append(m & MASK)
        out += [(m * 29 + w * 13 + 5) & MASK for w in words[:2]]
    return out or [0]


def instances(s: str) -> list[list[int]]:
    """The features of a sentence and, around the marked words of one with much besides, of their neighbourhood alone."""
    words, marks, places = words_of(s)
    out = [features(words, marks)]
    if places and len(words) > 2 * NEAR:
        a, b = max(0, places[0] - NEAR), places[-1] + NEAR
        if b - a < len(words):
            out.append(features(words[a : b + 1], marks))
        out.append(features(words[max(0, places[0] - NEAR // 2) : places[0] + NEAR // 2 + 1], marks[:1]))
    return out


_kept: dict[str, list[array]] = {}


def kept_instances(s: str) -> list[array]:
    """The same as packed arrays; those of sentences of ordinary length are kept for the worker: 100,000 of at most 200 characters."""
    if len(s) > 200:
        return [array("i", x) for x in instances(s)]
    k = _kept.get(s)
    if k is None:
        if len(_kept) >= 100_000:
            _kept.clear()
        k = _kept[s] = [array("i", x) for x in instances(s)]
    return k


class Sentences:
    """Sentences of documents as one sparse array."""

    def __init__(self, texts: list[str | None]):
        ids, starts, docs = array("i"), array("i"), array("i")
        for d, t in enumerate(texts):
            for s in sentences(t):
                for x in kept_instances(s):
                    starts.append(len(ids))
                    docs.append(d)
                    ids.extend(x)
        self._hold(np.frombuffer(ids, np.int32) if ids else np.empty(0, np.int32), np.array(starts, np.int64), np.array(docs, np.int64))

    @classmethod
    def of(cls, ids: np.ndarray, starts: np.ndarray) -> Sentences:
        """Sentences whose features are known, without their documents."""
        out = object.__new__(cls)
        out._hold(ids, starts, np.zeros(len(starts), np.int64))
        return out

    def _hold(self, ids: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> None:
        self.ids, self.starts, self.docs = ids, starts, docs
        lengths = np.diff(np.append(starts, len(ids)))
        self.scale = 1 / np.sqrt(np.maximum(lengths, 1)) if len(starts) else np.empty(0)
        self.row = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)

    def __len__(self) -> int:
        return len(self.starts)

    def score(self, w: np.ndarray, bias: float) -> np.ndarray:
        if not len(self):
            return np.empty(0)
        return np.add.reduceat(w[self.ids], self.starts) * self.scale + bias

    def gradient(self, g: np.ndarray) -> np.ndarray:
        """What a change of each sentence's score by g means for the weights."""
        return np.bincount(self.ids, (g * self.scale)[self.row], minlength=MASK + 1)

    def pick(self, keep: np.ndarray) -> Sentences:
        out = object.__new__(Sentences)
        lengths = np.diff(np.append(self.starts, len(self.ids)))
        out.ids = self.ids[np.repeat(keep, lengths)]
        lengths = lengths[keep]
        out.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.empty(0, np.int64)
        out.docs, out.scale = self.docs[keep], self.scale[keep]
        out.row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def share_of(x: Sentences, n: np.ndarray, w: np.ndarray, bias: float) -> tuple[np.ndarray, float, float, float]:
    """What unlabelled sentences, each n times, add to (the gradient, the bias's, the sum of losses, the count of positive scores)."""
    z = x.score(w, bias)
    s = _sigmoid(z)
    g = n * s * (1 - s)
    return x.gradient(g), float(g.sum()), float((n * s).sum()), float(n[z > 0].sum())


class Held:
    """Unlabelled documents at hand."""

    def __init__(self, texts: list[str]):
        self.x, self.docs = Sentences(texts), len(texts)
        self.n = np.ones(len(self.x))

    def __len__(self) -> int:
        return len(self.x)

    def seen(self) -> np.ndarray:
        return np.bincount(self.x.ids, minlength=MASK + 1)

    def share(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float, float, float]:
        return share_of(self.x, self.n, w, bias)


class Spread:
    """The unlabelled documents of a table, whatever their number: their different sentences with their counts stay on the
    cluster, and every sum over them is a job that gives a vector and three numbers a partition. Up to `held` features
    they are brought to the driver, all of them, which saves the jobs."""

    def __init__(self, texts: DataFrame, held: int = HELD):
        self.sc = texts.sparkSession.sparkContext
        parts = max(1, min(PARTS, self.sc.defaultParallelism))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                c = Counter(s for t in b.column(0).to_pylist() for s in sentences(t))
                yield pa.RecordBatch.from_arrays([pa.array([s.encode("utf-8", "replace") for s in c], pa.binary()), pa.array(list(c.values()), pa.int64())], names=["s", "n"])

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, n = [], []
                for s, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for x in instances(s.decode()):
                        ids.append(array("i", x).tobytes())
                        n.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(n, pa.int64())], names=["ids", "n"])

        once = texts.mapInArrow(split, "s BINARY, n BIGINT").groupBy("s").agg(F.sum("n").alias("n"))
        # in one order, so that sums of floating-point numbers are the same each time
        self.rows = cut_lineage(once.mapInArrow(hashed, "ids BINARY, n BIGINT").groupBy("ids").agg(F.sum("n").alias("n")).repartition(parts, "ids").sortWithinPartitions("ids"))
        self.docs = texts.count()
        self.size, features_ = self.rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length("ids")), F.lit(0)) / 4).first()
        self.blocks = [unpacked(b) for b in self.rows.toArrow().to_batches(max_chunksize=8192)] if features_ <= held else None

    def __len__(self) -> int:
        return self.size

    def _sums(self, w: np.ndarray | None, bias: float) -> tuple[np.ndarray, float, float, float]:
        if self.blocks is not None:
            return summed(self.blocks, w, bias)
        model = self.sc.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, *rest = summed(map(unpacked, batches), model.value, bias)
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary()), *(pa.array([v]) for v in rest)], names=["g", "gb", "loss", "up"])

        got = self.rows.mapInArrow(run, "g BINARY, gb DOUBLE, loss DOUBLE, up DOUBLE").collect()  # at most PARTS rows
        model.destroy()
        total = np.zeros(MASK + 1)
        for r in got:
            total += np.frombuffer(r["g"], np.float32)
        return total, sum(r["gb"] for r in got), sum(r["loss"] for r in got), sum(r["up"] for r in got)

    def seen(self) -> np.ndarray:
        return self._sums(None, 0.0)[0]

    def share(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float, float, float]:
        return self._sums(w, bias)


def summed(blocks: Iterable[tuple[Sentences, np.ndarray]], w: np.ndarray | None, bias: float) -> tuple[np.ndarray, float, float, float]:
    """The shares of all blocks; without weights, how often each feature occurs."""
    total, rest = np.zeros(MASK + 1), np.zeros(3)
    for x, n in blocks:
        if w is None:
            total += x.gradient(n / x.scale)
        else:
            g, *more = share_of(x, n, w, bias)
            total += g
            rest += more
    return total, *map(float, rest)


def unpacked(b: pa.RecordBatch) -> tuple[Sentences, np.ndarray]:
    """The sentences of a batch of (ids, n), and how often each occurs."""
    c = b.column(0)
    at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int32)
    ids = np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.int32) if len(c) else np.empty(0, np.int32)
    return Sentences.of(ids, (at[:-1] - at[0]).astype(np.int64) // 4), b.column(1).to_numpy(zero_copy_only=False).astype(float)


def fit_nnpu(pos: Sentences, unl: Sentences, cleared: np.ndarray, pi: float, free: Held | Spread, steps: int = STEPS, rate: float = 0.15, decay: float = 2e-5, w0: np.ndarray | None = None, b0: float = -2.0) -> tuple[np.ndarray, float]:
    """Weights that minimise the non-negative risk with the sigmoid loss, by Adam. unl: the sentences of documents that annotators
    cleared, free: the unlabelled ones. Sentences that are known to be cleared take part among the unlabelled with the logistic loss, whose slope doesn't vanish: they are known to be negative."""
    w, bias = (np.zeros(MASK + 1) if w0 is None else w0.copy()), b0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight, n = 1 / max(1, len(pos)), len(unl) + len(free)
    cleared = cleared if len(free) or not cleared.all() else np.zeros_like(cleared)
    open_ = len(free) + np.count_nonzero(~cleared)
    at = {1 + int(steps * (k / SNAPSHOTS) ** SPACING) for k in range(SNAPSHOTS)}
    ratio, kept = len(free) / max(1, len(unl)), None
    for t in range(1, steps + 1):
        zp, zu = pos.score(w, bias), unl.score(w, bias)
        sp, su = _sigmoid(zp), _sigmoid(zu)
        now = (unl.gradient(su * (1 - su)), float((su * (1 - su)).sum()), float(su.sum()))
        if t in at:
            kept = (free.share(w, bias)[:3], now)
        gf, gfb, loss = (whole + ratio * (new - old) for whole, new, old in zip(kept[0], now, kept[1]))
        # the loss is s(-z) for a positive and s(z) for a negative; either has the slope s(1-s)
        push = WARM if 3 * t < steps else 1
        gp, gu = -pi * push * weight * sp * (1 - sp), su * np.where(cleared, CLEARED, 1 - su) / n
        turn = 1
        if (np.sum(su[~cleared]) + loss) / open_ - pi * np.sum(weight * sp) >= 0:
            gp = 2 * gp
        else:
            gu, gp, turn = np.where(cleared, gu, -gu), np.zeros_like(gp), -1
        g = pos.gradient(gp) + unl.gradient(gu) + turn * gf / n + decay * pi * w
        gb = gp.sum() + gu.sum() + turn * gfb / n
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        mb, vb = mb + 0.1 * (gb - mb), vb + 0.01 * (gb * gb - vb)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w, bias


def _best_of(docs: np.ndarray, z: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf)
    np.maximum.at(out, docs, z)
    return out


def learn(positive: list[str], negative: list[str], unlabelled: list[str] | DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weights, bias) from confirmed documents, cleared ones and unlabelled ones (a list, or a table of their texts). Without confirmed documents nothing is flagged."""
    if not positive:
        return np.zeros(MASK + 1), -10.0
    pos, rest = Sentences(positive), Sentences(negative)
    free = Held(unlabelled) if isinstance(unlabelled, list) else Spread(unlabelled)
    n = len(rest) + len(free)
    if not len(pos) or not n:
        return np.zeros(MASK + 1), -10.0
    share = len(positive) / max(1, len(positive) + len(negative))
    per_doc = n / max(1, len(negative) + free.docs)
    # labelled documents are picked, so their share of positives is only an upper bound of the prior; it is estimated anew from each round's model
    most = float(np.clip(share / max(per_doc, 1), 1e-4, 0.2))
    pi = PRIOR * most
    # round 0: the sentence whose features confirmed documents have oftenest against all others is the likely reason
    seen = np.bincount(rest.ids, minlength=MASK + 1) + free.seen() + 1.0
    lengths = np.diff(np.append(pos.starts, len(pos.ids)))
    once = np.unique(np.stack([np.repeat(pos.docs, lengths), pos.ids]), axis=1)[1]
    held = np.bincount(once, minlength=MASK + 1)
    odds = np.log((held + 0.1) / len(positive)) - np.log((seen + SMOOTH) / n)
    z = np.add.reduceat(odds[pos.ids], pos.starts) * pos.scale**2
    keep = z >= _best_of(pos.docs, z, len(positive))[pos.docs]
    for _ in range(rounds):
        chosen = pos.pick(keep)
        # annotators miss some: a cleared sentence made of what several positives have isn't taken for known
        common = (np.bincount(chosen.ids, minlength=MASK + 1) >= 3).astype(float)
        alike = np.add.reduceat(common[rest.ids], rest.starts) * rest.scale**2 if len(rest) else np.empty(0)
        w, bias = fit_nnpu(chosen, rest, alike < ALIKE, pi, free)
        z = pos.score(w, bias)
        pi = float(np.clip(1.5 * (np.count_nonzero(rest.score(w, bias) > 0) + free.share(w, bias)[3]) / n, PRIOR * most, most))
        top = _best_of(pos.docs, z, len(positive))
        surer = (z > 0) | (z >= top[pos.docs]) & (z > -1)
        keep = surer if surer.any() else keep
    return w, bias


def document_scores(texts: list[str | None], w: np.ndarray, bias: float) -> np.ndarray:
    """The score of each text's likeliest sentence; -inf for texts without one."""
    x = Sentences(texts)
    return _best_of(x.docs, x.score(w, bias), len(texts)) if len(x) else np.full(len(texts), -np.inf)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(weights, bias) from the tables. A document with more votes for than against counts as confirmed."""
    votes = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "annotator", "label").distinct().groupBy("doc_id").agg(F.avg("label").alias("vote"))
    votes = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    votes = votes.join(texts.where(F.length("text") <= MAX_CHARS).select("doc_id"), "doc_id", "left_semi")
    got = texts.join(votes, "doc_id").select("doc_id", "text", "vote").orderBy("doc_id").collect()
    positive = [r["text"] for r in got if r["vote"] > 0.5]
    negative = [r["text"] for r in got if r["vote"] < 0.5]
    return learn(positive, negative, texts.join(votes, "doc_id", "left_anti").select("text"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, score (0 to 1), flagged: every document.

    Null, empty and blank texts score 0 and aren't flagged. Without confirmed labels no document is flagged. Further
    columns are ignored."""
    w, bias = fitted(docs, labels)
    used = np.flatnonzero(w)
    model = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), w[used].astype(np.float32), bias))  # at most 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, b = model.value
        weights = np.zeros(MASK + 1)
        weights[at] = values
        for batch in batches:
            z = document_scores(batch.column("text").to_pylist(), weights, b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(_sigmoid(z)), pa.array(z > 0)], names=["doc_id", "source", "score", "flagged"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id BIGINT, source STRING, score DOUBLE, flagged BOOLEAN")


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id of each document with an abusive, hateful or sexual passage."""
    return scored(docs, labels).where("flagged AND doc_id IS NOT NULL").select("doc_id").distinct()


def rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """source, documents, flagged, rate, mean_score for each source; null sources are one group."""
    return scored(docs, labels).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("int")).alias("rate"), F.avg("score").alias("mean_score")
    )
