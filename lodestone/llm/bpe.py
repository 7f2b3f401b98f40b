"""Byte-level BPE encoding in overlapping chunks, and decoding.

A long text is cut into chunks that overlap.  Each chunk is pre-tokenised by itself,
in parallel; in the overlap with the next one, the first pre-token boundary that both
have is where they resynchronise, as from a common boundary on both read the same.
Texts are cut there, and the pieces encoded in parallel.  A boundary after a blank is
no place to cut, as the blanks before it would be read otherwise at a piece's end.
Where two chunks have no such boundary (one word or blank that fills the overlap) they stay one piece.
Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc

#: Where the ranks of a public byte-level vocabulary are; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a chunk, and of what it shares with the next.
CHUNK, OVERLAP = 32768, 512
#: A boundary so near a chunk's end may depend on what follows.
UNSURE = 4


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Vocabulary:
    """Ranks made ready for a process: the encoder, and all tokens' bytes in one row."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        self.length = np.zeros(by_id[-1][1] + 1, np.int64)
        self.length[[k for _, k in by_id]] = [len(x) for x, _ in by_id]
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(x for x, _ in by_id), np.uint8)

    def raw(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of tokens, and where each token's begin and end among them (n + 1 values)."""
        size = self.length[tokens]
        end = np.concatenate([[0], np.cumsum(size)])
        return self.blob[np.repeat(self.start[tokens] - end[:-1], size) + np.arange(end[-1])], end


_ready: list[tuple[dict[bytes, int], Vocabulary]] = []


def ready(vocabulary) -> Vocabulary:
    """The vocabulary of a broadcast of ranks; made once in a process, the last one is held."""
    ranks = vocabulary.value
    if not _ready or _ready[0][0] is not ranks:
        _ready[:] = [(ranks, Vocabulary(ranks))]
    return _ready[0][1]


def boundaries(text: str, pattern: regex.Pattern) -> list[int]:
    """Where pre-tokens begin and end, so 0 and the length among them."""
    return [0, *(m.end() for m in pattern.finditer(text))] if text else [0]


RESULT = "struct<n_tokens: int, tokens: array<int>, exact: boolean>"


#: Bytes of text whose tokens are made at a time.
BLOCK = 1 << 20


def _encode_all(texts: pa.Array, vocabulary) -> pa.Array:
    v = ready(vocabulary)
    data, off = tc.buffers(texts)
    tokens, counts, exact = [np.zeros(0, np.int32)], [], []
    for a, b in tc.blocks(off, BLOCK):
        ids = [v.encoding.encode_to_numpy(x) if x else np.zeros(0, np.uint32) for x in texts.slice(a, b - a).to_pylist()]
        flat = np.concatenate(ids)
        n = np.array([len(x) for x in ids], np.int64)
        raw, end = v.raw(flat)
        at = end[np.concatenate([[0], np.cumsum(n)])]
        exact += [np.array_equal(raw[x:y], data[s:e]) for x, y, s, e in zip(at, at[1:], off[a:b], off[a + 1 : b + 1])]
        tokens.append(flat.astype(np.int32))
        counts.append(n)
    n = np.concatenate([np.zeros(0, np.int64), *counts])
    ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tokens)), mask=pc.is_null(texts))
    return pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), lists, pa.array(exact, pa.bool_())], ["n_tokens", "tokens", "exact"])


def _whole(vocabulary):
    @F.arrow_udf(RESULT)
    def encode(texts: pa.Array) -> pa.Array:
        return _encode_all(texts, vocabulary)

    return encode


def _decoder(vocabulary):
    @F.arrow_udf("binary")
    def decode(tokens: pa.Array) -> pa.Array:
        v, out = ready(vocabulary), []
        for k in range(0, len(tokens), 256):
            some = tokens.slice(k, 256)
            raw, end = v.raw(some.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            n = pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)
            at = end[np.concatenate([[0], np.cumsum(n)])]
            out += [raw[x:y].tobytes() if good else None for x, y, good in zip(at, at[1:], some.is_valid().to_pylist())]
        return pa.array(out, pa.binary())

    return decode


def decode(tokens: Column, vocabulary) -> Column:
    """The raw bytes of an array of tokens; null for null, empty for empty.  ``vocabulary``: a broadcast of ranks."""
    return _decoder(vocabulary)(tokens)


def _cut(chunk: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                key, text = key.as_py(), text.as_py()
                at = range(0, len(text), chunk)
                for some in (at[k : k + 256] for k in range(0, len(at), 256)):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.string()), pa.array([a // chunk for a in some], pa.int32()), pa.array([text[a : a + chunk + overlap] for a in some], pa.string())], ["key", "no", "chunk"])

    return cut


def _mark(chunk: int, overlap: int, pattern: str):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            head, tail = [], []
            for text in batch.column(2).to_pylist():
                at = boundaries(text, compiled)
                head.append([x for x in at if x < overlap])
                tail.append([x - chunk for x in at if chunk <= x < len(text) - UNSURE and not text[x - 1].isspace()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], ["key", "no", "head", "tail"])

    return mark


def _pieces(texts: DataFrame, chunk: int, overlap: int, pattern: str) -> DataFrame:
    """(key, piece, text) of (key, text): texts cut where chunks resynchronise."""
    chunks = texts.mapInArrow(_cut(chunk, overlap), "key string, no int, chunk string").repartition("key", "no")
    marks = chunks.mapInArrow(_mark(chunk, overlap, pattern), "key string, no int, head array<int>, tail array<int>")
    # where pre-tokens end in the overlaps: a few numbers a chunk, the text itself doesn't go through the window
    order = Window.partitionBy("key").orderBy("no")
    joins = marks.select("key", "no", "tail", F.lead("head").over(order).alias("next_head"))
    joins = joins.select("key", "no", F.col("next_head").isNull().alias("last"), F.array_min(F.array_intersect("tail", "next_head")).alias("to"))
    begun = joins.withColumn("since", F.lag("to").over(order))
    begun = begun.withColumn("piece", F.sum(F.when(F.col("since").isNotNull(), 1).otherwise(0)).over(order).cast("int"))
    parts = chunks.join(begun, ["key", "no"])
    begin = F.coalesce("since", F.lit(0))
    end = F.when(F.col("last"), F.length("chunk")).otherwise(F.coalesce("to", F.lit(0)) + chunk)
    parts = parts.select("key", "piece", "no", F.substr("chunk", begin + 1, end - begin).alias("text"))
    return parts.groupBy("key", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), "").alias("text"))


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns ``keep`` with n_tokens, tokens and exact: the ids of each whole text,
    and whether the bytes they decode to are the text's.

    Texts up to a chunk are encoded where they are; of longer ones, each different one
    is cut, spread and encoded once.  A null text has null tokens, 0 of them, an empty
    one an empty array, and both are exact; repeated rows each give a row; an empty
    table gives an empty one.  A null id is kept as any other value; of boundaries where
    two chunks resynchronise the first is taken.  Columns that aren't kept are ignored.
    """
    if overlap >= chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).alias("text"))
    brief = rows.filter(F.coalesce(F.length("text"), F.lit(0)) <= chunk).select("row", _whole(ranks)(F.col("text")).alias("r"))
    long = rows.filter(F.length("text") > chunk).select("row", F.sha2("text", 256).alias("key"), "text")
    pieces = _pieces(long.select("key", "text").dropDuplicates(["key"]), chunk, overlap, PATTERN)
    coded = pieces.select("key", "piece", _whole(ranks)(F.col("text")).alias("r")).select("key", "piece", "r.tokens", "r.exact")
    whole = coded.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", "tokens"))).alias("p"), F.every("exact").alias("exact"))
    tokens = F.flatten(F.transform("p", lambda x: x["tokens"]))
    whole = whole.select(F.col("key").alias("k"), F.struct(F.size(tokens).alias("n_tokens"), tokens.alias("tokens"), "exact").alias("r"))
    out = long.select("row", "key").join(whole, F.col("key") == F.col("k")).select("row", "r")
    return brief.unionByName(out).select(*[F.col("row")[c].alias(c) for c in keep], "r.n_tokens", "r.tokens", "r.exact")
