"""Problem 7: the corpus encoded with a public byte-level tokenizer, by overlapping chunks.

A text up to CHUNK characters is one chunk and is encoded where it is read. A longer one is cut into chunks that
overlap by OVERLAP characters, and the chunks spread over all tasks: each is pre-tokenised alone, neighbours are
stitched at the first boundary that both found in their overlap (there the scanner is in the same state, so from there
on both find the same), and the pieces between the stitches are encoded alone. Where neighbours never agree within an
overlap (one word longer than it), the text is encoded whole. Decoding concatenates the bytes of the tokens.
"""

from __future__ import annotations

import base64
import hashlib
import importlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.session import cut_lineage

#: Characters of a chunk, and how many of them the next chunk has too.
CHUNK, OVERLAP = 8192, 512
#: A boundary counts only this far from a chunk's end: what follows the chunk could still move the last ones.
MARGIN = 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    return importlib.import_module("public_tokenizers").path(name)


@lru_cache(maxsize=4)
def coder(path: str, pattern: str):
    """The tokenizer of a ranks file; loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def scanner(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str) -> list[int]:
    """Where the pre-tokens of a text end."""
    return [m.end() for m in scanner(pattern).finditer(text)]


def spans(length: int) -> list[tuple[int, int]]:
    """(begin, end) of the overlapping chunks of a text."""
    if length <= CHUNK:
        return [(0, length)]
    stride = CHUNK - OVERLAP
    return [(b, min(b + CHUNK, length)) for b in range(0, length - OVERLAP, stride)]


def encode_texts(texts: list[str | None], path: str, pattern: str) -> list[list[int]]:
    """The ids of texts that fit a chunk; null and empty texts have none."""
    c = coder(path, pattern)
    out: list[list[int]] = [[] for _ in texts]
    filled = [(k, t) for k, t in enumerate(texts) if t]
    for (k, _), ids in zip(filled, c.encode_ordinary_batch([t for _, t in filled], num_threads=1)):
        out[k] = ids
    return out


def stitch(left: list[int], right: list[int], begin: int, end: int) -> int | None:
    """The first boundary (position in the text) that both chunks found between begin and end."""
    both = set(right)
    return next((p for p in left if begin <= p < end and p in both), None)


def encode_long(text: str, path: str, pattern: str) -> list[int]:
    """One long text on one machine, by the same chunks and stitches as the distributed way; the tests compare them."""
    parts = spans(len(text))
    found = [[b + p for p in boundaries(text[b:e], pattern)] for b, e in parts]
    at = [0]
    for (left, right), (b, _), (_, e) in zip(zip(found, found[1:]), parts[1:], parts):
        s = stitch(left, right, b, e - MARGIN)
        if s is None:
            return coder(path, pattern).encode_ordinary(text)
        at.append(s)
    at.append(len(text))
    return [i for a, b in zip(at, at[1:]) for i in coder(path, pattern).encode_ordinary(text[a:b])]


def _chunk_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row, key, chunk_no, begin, chunk, copies: the chunks of the long texts. `row` is a digest of key and text, so a task
    that is run again gives the same; rows with equal ones are counted in `copies`."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0), b.column(1).to_pylist()):
                parts = spans(len(t))
                n, row = len(parts), hashlib.md5(f"{k.as_py()}\0{t}".encode("utf-8", "surrogatepass")).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n), pa.array([k.as_py()] * n, b.column(0).type), pa.array(range(n), pa.int32()), pa.array([x for x, _ in parts], pa.int32()), pa.array([t[x:y] for x, y in parts], pa.string())],
                    names=["row", key, "chunk_no", "begin", "chunk"],
                )

    rows = docs.where(F.length(text) > CHUNK).select(key, text).mapInArrow(run, f"row STRING, `{key}` {kind}, chunk_no INT, begin INT, chunk STRING")
    return rows.groupBy("row", "chunk_no").agg(F.first(key).alias(key), F.first("begin").alias("begin"), F.first("chunk").alias("chunk"), F.count(F.lit(1)).alias("copies"))


def _edges(chunks: DataFrame, pattern: str) -> DataFrame:
    """row, chunk_no, head, tail: the boundaries of each chunk inside the overlaps with its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = [], []
            for begin, chunk in zip(b.column("begin").to_pylist(), b.column("chunk").to_pylist()):
                at = [begin + p for p in boundaries(chunk, pattern)]
                heads.append([p for p in at if p < begin + OVERLAP - MARGIN])
                tails.append([p for p in at if begin + CHUNK - OVERLAP <= p < begin + CHUNK - MARGIN])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("chunk_no"), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=["row", "chunk_no", "head", "tail"])

    return chunks.select("row", "chunk_no", "begin", "chunk").mapInArrow(run, "row STRING, chunk_no INT, head ARRAY<INT>, tail ARRAY<INT>")


def _pieces(chunks: DataFrame, path: str, pattern: str) -> DataFrame:
    """row, chunk_no, ids: each chunk's part between its stitches, encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("begin", "chunk", "start", "stop")}
            ids = encode_texts([t[x - o : None if y is None else y - o] for o, t, x, y in zip(c["begin"], c["chunk"], c["start"], c["stop"])], path, pattern)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("chunk_no"), pa.array(ids, pa.list_(pa.int32()))], names=["row", "chunk_no", "ids"])

    return chunks.select("row", "chunk_no", "begin", "chunk", "start", "stop").mapInArrow(run, "row STRING, chunk_no INT, ids ARRAY<INT>")


def _whole(docs: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encode_texts(b.column(1).to_pylist(), path, pattern), pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids ARRAY<INT>")


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key, ids: the token ids of each text, one row per row of docs.

    Null, empty and over-long texts: the empty list, the empty list, and the ids by chunks. Special-token strings are
    ordinary text. The vocabulary's path is a parameter; workers read it where they run. Further columns are ignored.
    """
    import public_tokenizers

    path, pattern = vocabulary or vocabulary_path(), public_tokenizers.PATTERN
    docs = docs.select(key, text)
    short = _whole(docs.where(F.coalesce(F.length(text), F.lit(0)) <= CHUNK), key, text, path, pattern)
    chunks = cut_lineage(_chunk_rows(docs, key, text))
    edge = cut_lineage(_edges(chunks, pattern))
    left = edge.select("row", (F.col("chunk_no") + 1).alias("chunk_no"), "tail")
    stitched = cut_lineage(edge.select("row", "chunk_no", "head").join(left, ["row", "chunk_no"]).select("row", "chunk_no", F.array_min(F.array_intersect("tail", "head")).alias("at")))
    broken = stitched.where("at IS NULL").select("row").distinct()
    starts = stitched.select("row", "chunk_no", F.col("at").alias("start"))
    stops = stitched.select("row", (F.col("chunk_no") - 1).alias("chunk_no"), F.col("at").alias("stop"))
    ready = chunks.join(broken, "row", "left_anti").join(starts, ["row", "chunk_no"], "left").join(stops, ["row", "chunk_no"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    joined = _pieces(ready, path, pattern).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "ids"))).alias("parts"))
    keys = chunks.where("chunk_no = 0").select("row", key, F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    long = joined.join(keys, "row").select(key, F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    # texts whose chunks never agree are put together again and encoded whole
    again = chunks.join(broken, "row", "left_semi").groupBy("row").agg(F.first(key).alias(key), F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("c"), F.first("copies").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    stride = CHUNK - OVERLAP
    whole = F.array_join(F.transform("c", lambda e, i: F.when(i + 1 < F.size("c"), F.substring(e["chunk"], 1, stride)).otherwise(e["chunk"])), "")
    return short.unionByName(long).unionByName(_whole(again.select(key, whole.alias(text)), key, text, path, pattern))


def decode(ids: list[int], vocabulary: str | None = None) -> str:
    """The text of a list of ids: the tokens' bytes one after the other."""
    import public_tokenizers

    c = coder(vocabulary or vocabulary_path(), public_tokenizers.PATTERN)
    return b"".join(c.decode_single_token_bytes(i) for i in ids).decode("utf-8", "replace")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key, n_tokens for each text; 0 for null and empty texts."""
    return encoded(docs, key, text, vocabulary).select(key, F.size("ids").alias("n_tokens"))
