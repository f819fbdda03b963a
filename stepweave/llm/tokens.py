"""Byte-pair encoding with the rank files of public tokenizers.

Method: the text is split by the tokenizer's pattern; the bytes of a piece are
the leaves of a segment tree whose inner nodes hold the leftmost minimum of the
pair ranks below. A merge takes the root's pair, joins it to one live node and
updates the two or three leaves it touches in logarithmic time, so that a piece
of n bytes costs O(n log n), however long it is.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the vocabulary files and the rank file's name; both are parameters of every function that needs them.
TOKENIZER_DIR = os.environ.get("STEPWEAVE_TOKENIZERS", "/opt/tokenizers")
RANK_FILE = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern published with these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by a worker, and the longest remembered piece: at most some 100 MB.
CACHE_PIECES, CACHE_CHARS = 200_000, 64
NONE = 1 << 30


def load_ranks(folder: str = TOKENIZER_DIR, name: str = RANK_FILE) -> dict[bytes, int]:
    """Token bytes to id, read from a rank file. The file ends with the vocabulary: its size is fixed."""
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of lowest rank, of equal ones the leftmost, is merged until none has a rank."""
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if n < 2:
        return [ranks[piece]] if n else []
    get = ranks.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    # tree[size + i] is the rank of the pair that starts at byte i; an inner node holds the smaller of its children.
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    end = list(range(1, n + 1))  # end[i]: where the live token that starts at i ends
    before = list(range(-1, n - 1))  # before[i]: where the live token in front of it starts

    def put(i: int, rank: int) -> None:
        i += size
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    while tree[1] < NONE:
        least, i = tree[1], 1
        while i < size:  # down to the leftmost leaf that holds the minimum
            i *= 2
            if tree[i] != least:
                i += 1
        i -= size
        j = end[i]
        e = end[j]
        end[i] = e
        if e < n:
            before[e] = i
            put(j, NONE)
            put(i, get(piece[i : end[e]], NONE))
        else:
            if j < n - 1:
                put(j, NONE)
            put(i, NONE)
        p = before[i]
        if p >= 0:
            put(p, get(piece[p:e], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts; remembers short pieces up to a fixed number."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.split, self.known = ranks, regex.compile(pattern).findall, {}

    def piece(self, p: str) -> array:
        ids = array("i", merge_bytes(p.encode("utf-8", "replace"), self.ranks))
        if len(p) <= CACHE_CHARS:
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            self.known[p] = ids
        return ids

    def into(self, out: array, text: str) -> None:
        known = self.known
        for p in self.split(text):
            ids = known.get(p)
            out.extend(self.piece(p) if ids is None else ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.into(out, text)
        return out.tolist()

    def count(self, text: str | None) -> int:
        known, n = self.known, 0
        for p in self.split(text or ""):
            ids = known.get(p)
            n += len(self.piece(p) if ids is None else ids)
        return n


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, ranks) -> Encoder:
    """One encoder a worker process and vocabulary; its memory is bounded."""
    if key not in _encoders:
        _encoders[key] = Encoder(ranks.value)
    return _encoders[key]


def shared_ranks(spark: SparkSession, folder: str = TOKENIZER_DIR, name: str = RANK_FILE):
    """The vocabulary as a broadcast: some 50 thousand entries, a fixed file that workers need not have."""
    return spark.sparkContext.broadcast(load_ranks(folder, name))


#: Texts and ids that are held at once.
SLICE_ROWS, SLICE_IDS = 256, 1 << 20


def encode_texts(df: DataFrame, *, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR, name: str = RANK_FILE) -> DataFrame:
    """key and ``ids``, the token ids of each row's whole text without special tokens.

    The strings of special tokens are ordinary text. Null and empty texts give
    an empty list; repeated rows give repeated rows; a null key stays null.
    """
    ranks, tag = shared_ranks(df.sparkSession, folder, name), f"{folder}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(tag, ranks)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            ids, ends, at = array("i"), [0], 0
            for i in range(b.num_rows):
                t = texts[i].as_py()
                if t:
                    e.into(ids, t)
                ends.append(len(ids))
                if i + 1 == b.num_rows or i + 1 - at >= SLICE_ROWS or len(ids) >= SLICE_IDS:
                    lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.empty(0, np.int32)))
                    yield pa.RecordBatch.from_arrays([keys.slice(at, i + 1 - at), lists], names=["key", "ids"])
                    ids, ends, at = array("i"), [0], i + 1

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, *, text: str = "text", out: str = "n_tokens", keep: list[str], folder: str = TOKENIZER_DIR, name: str = RANK_FILE) -> DataFrame:
    """The columns ``keep`` and the number of tokens of each row's whole text; 0 for null."""
    ranks, tag = shared_ranks(df.sparkSession, folder, name), f"{folder}/{name}"
    part = df.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(tag, ranks)
        for b in batches:
            n = [e.count(t.as_py()) for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(n, pa.int64())], names=[*keep, out])

    schema = ", ".join([*[f"`{k}` {part.schema[k].dataType.simpleString()}" for k in keep], f"`{out}` long"])
    return part.mapInArrow(run, schema)
