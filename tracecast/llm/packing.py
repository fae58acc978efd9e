"""Best-fit packing of token sequences by linear grouping.

Documents are cut into pieces of at most ``capacity`` tokens. Pieces are dealt to shards of bounded
size. In a shard the large lengths are sorted and split into groups of equal cardinality, and rounded up
to the longest of their group, which leaves few sizes; the best mix of configurations of these
sizes is found by a linear programme (column generation), rounded down, and filled with actual pieces.
Room that is left, and what no configuration holds, goes to the longest piece that fits.

A null or empty text is its end token alone. Repeated rows are packed each on its own; further
columns are ignored, ids may be null, texts are read whole. Pieces of one length are alike; which goes where may differ, the number of
sequences does not. No documents give no rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecast.llm.common import batch_of, id_and_text, released, slices
from tracecast.storage import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class PackSettings:
    capacity: int = 2048
    #: Vocabulary whose ids are those of ``byte_bpe_50k.json``.
    vocabulary: str = "byte_bpe_50k.tiktoken"
    #: Tokenizer file whose added tokens have ids of their own wherever a text holds them.
    tokenizer: str = "byte_bpe_50k.json"
    end_id: int = 0
    #: Pieces packed together in one task.
    shard_rows: int = 50_000
    #: Lengths over this share of the capacity are large, and this many sizes stand for them.
    large_share: float = 0.25
    groups: int = 40


@cache
def _encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(vocabulary), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _added(tokenizer: str) -> tuple[re.Pattern | None, dict[str, bytes]]:
    """Pattern that finds the added tokens of a tokenizer file, longest first, and the id of each."""
    with open(public_tokenizers.path(tokenizer), encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError("added tokens that take their surroundings are not supported")
    ids = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in tokens}
    return re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None, ids


#: A word with the blank before it, or white space: no token crosses these bounds.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that Python takes for white space and the vocabulary's pattern does not.
_ODD = re.compile("[\x1c-\x1f]")
_CACHED = 300_000


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes; chunks seen before are looked up.

    Added tokens part a text: what stands between them is encoded on its own.
    """

    def __init__(self, vocabulary: str, tokenizer: str = PackSettings.tokenizer):
        self.encode = _encoding(vocabulary).encode_ordinary
        self.added, self.added_ids = _added(tokenizer)
        self.known: dict[str, bytes] = {}

    def _new(self, chunk: str) -> bytes:
        if len(self.known) >= _CACHED:
            self.known.clear()
        ids = self.known[chunk] = np.array(self.encode(chunk), "<u4").tobytes()
        return ids

    def __call__(self, text: str) -> bytes:
        out, done = [], 0
        for m in self.added.finditer(text) if self.added else ():
            out += [self._ordinary(text[done : m.start()]), self.added_ids[m[0]]]
            done = m.end()
        return b"".join([*out, self._ordinary(text[done:])]) if done else self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        known = self.known.get
        return b"".join([known(chunk) or self._new(chunk) for chunk in _CHUNK.findall(text)])


def cut(ids: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: all full but the first."""
    first = (ids - 1) % capacity + 1
    return [(0, first)] + [(start, capacity) for start in range(first, ids, capacity)]


def _pieces(settings: PackSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(settings.vocabulary, settings.tokenizer), np.array([settings.end_id], "<u4").tobytes()
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = encode(text) + end
                for i, (start, length) in enumerate(cut(len(ids) // 4, settings.capacity)):
                    rows.append((doc_id, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return released(run)


def pieces(docs: DataFrame, settings: PackSettings = PackSettings()) -> DataFrame:
    return id_and_text(docs).mapInArrow(_pieces(settings), PIECES)


def _best_pattern(sizes: np.ndarray, gains: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest gain that fits, by dynamic programming over the room used."""
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(sizes), capacity + 1), np.int16)
    for i, (size, gain) in enumerate(zip(sizes, gains)):
        if gain <= 0:
            continue
        before = best.copy()
        for count in range(1, capacity // size + 1):
            other = before[: capacity + 1 - count * size] + count * gain
            better = other > best[count * size :] + 1e-12
            best[count * size :][better] = other[better]
            taken[i, count * size :][better] = count
    pattern, room = np.zeros(len(sizes), int), capacity
    for i in range(len(sizes) - 1, -1, -1):
        pattern[i] = taken[i, room]
        room -= pattern[i] * sizes[i]
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """How often to use which configuration: the linear programme over all that fit, rounded down.

    Starts from one-size configurations and swaps in the one that the current prices value most.
    """
    patterns = np.diag(capacity // sizes).astype(float)
    for _ in range(40 * len(sizes)):
        prices = np.linalg.solve(patterns.T, np.ones(len(sizes)))
        value, pattern = _best_pattern(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        used, step = np.linalg.solve(patterns, demand), np.linalg.solve(patterns, pattern)
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        patterns[:, int(np.argmin(ratio))] = pattern
    used = np.linalg.solve(patterns, demand)
    return [(patterns[:, i].astype(int), int(used[i] + 1e-9)) for i in range(len(sizes)) if used[i] >= 1 - 1e-9]


class _Waiting:
    """Pieces by length; the longest that fits a room is found in constant time."""

    def __init__(self, lengths: np.ndarray, numbers: np.ndarray):
        self.by_length, self.mask = defaultdict(list), 0
        for i in numbers[::-1].tolist():
            self.by_length[int(lengths[i])].append(i)
        for length in self.by_length:
            self.mask |= 1 << length

    def longest(self, room: int) -> int:
        """Length of it, or 0."""
        return max((self.mask & ((1 << (room + 1)) - 1)).bit_length() - 1, 0)

    def take(self, length: int) -> int:
        number = self.by_length[length].pop()
        if not self.by_length[length]:
            self.mask ^= 1 << length
        return number


def pack(lengths: np.ndarray, settings: PackSettings = PackSettings()) -> np.ndarray:
    """Number of the sequence of each piece.

    A configuration's sizes but the last are filled with the longest pieces up to each size; the last one, and
    the room that rounding leaves, with the longest pieces that fit, the small ones among them.
    """
    capacity = settings.capacity
    order = np.argsort(-lengths, kind="stable")
    out, n = np.full(len(lengths), -1), 0
    large = order[(lengths[order] < capacity) & (lengths[order] > settings.large_share * capacity)]
    plans: list[list[int]] = []
    if len(large):
        groups = np.array_split(large, min(settings.groups, len(large)))
        rounded = np.repeat([lengths[g[0]] for g in groups], [len(g) for g in groups])  # up to the longest of the group
        sizes, demand = np.unique(rounded, return_counts=True)
        for pattern, times in configurations(sizes, demand.astype(float), capacity):
            plans += [np.repeat(sizes, pattern)[::-1].tolist()] * times
    waiting = _Waiting(lengths, order)
    plans.sort(reverse=True)
    while waiting.mask:
        room = capacity
        for size in plans.pop(0)[:-1] if plans else ():
            if length := waiting.longest(min(size, room)):
                out[waiting.take(length)] = n
                room -= length
        while length := waiting.longest(room):
            out[waiting.take(length)] = n
            room -= length
        n += 1
    return out


def _packed(settings: PackSettings):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "row"], ascending=False, kind="stable").reset_index(drop=True)
        rows["sequence_id"] = pack(rows["length"].to_numpy(), settings) + rows["shard"] * (1 << 32)
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows.drop(columns=["row", "shard"])

    return run


def packed(docs: DataFrame, settings: PackSettings = PackSettings()) -> DataFrame:
    """Every piece with its sequence and its place there."""
    cut_docs = materialize(pieces(docs, settings).withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-cut_docs.count() // settings.shard_rows))
    dealt = cut_docs.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_packed(settings), f"{PIECES}, sequence_id long, offset long")
