"""7. Token-ID output: best-fit-decreasing with a segment tree over capacities, packed id matrices."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.llm.common import map_arrow, slices, texts
from overlace.llm.wordtok import WordEncoder

SCHEMA = "sequence_id long, n_tokens int, input_ids binary, ids_crc32 long, cu_seqlens array<int>, position_starts array<int>, doc_ids array<long>, doc_starts array<long>"


class CapacityTree:
    """How many open bins have each free room 0..capacity; the least room that is at least ``need`` in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, n: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += n
            k >>= 1

    def best_room(self, need: int) -> int:
        """-1 if none."""
        k = need + self.size
        if self.count[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices of lengths 1..capacity: longest first, each into the fullest bin that has room."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.best_room(lengths[i])
        if room < 0:
            b, room = len(bins), capacity
            bins.append([])
        else:
            b = tree.bins[room].pop()
            tree.add(room, -1)
        bins[b].append(i)
        tree.bins[room - lengths[i]].append(b)
        tree.add(room - lengths[i], 1)
    return bins


def position_ids(cu_seqlens, position_starts) -> np.ndarray:
    """Positions of a sequence's tokens: they begin anew at every piece, at its place in the document."""
    n = np.diff(cu_seqlens)
    return np.arange(cu_seqlens[-1]) - np.repeat(np.asarray(cu_seqlens[:-1]) - np.asarray(position_starts), n)


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, docs_at_once: int = 4096, bytes_at_once: int = 64 << 20, restart: bool = True) -> DataFrame:
    """One row per sequence of at most ``capacity`` ids.

    input_ids: unsigned 32-bit little-endian ids (a row of the id matrix, not padded); cu_seqlens: 0 and the end of each
    piece; position_starts: the position each piece begins with (0, or its place in the document unless
    ``restart``); doc_ids and doc_starts: the document of each piece and the ids before it. A document is its ids and
    ``end_id``; one longer than a sequence is cut into full ones and a rest, so no id is lost. A null text is empty. Packing
    runs in each task over ``docs_at_once`` documents, or fewer where their ids fill ``bytes_at_once``, so memory is bounded by that and
    the longest document, nothing is shuffled, and a lost task repeats only its own part. Repeated rows and null ids are packed like all others.
    """
    step, end = 4 * capacity, int(end_id).to_bytes(4, "little")

    def run(batches):
        encode, part = WordEncoder.shared(tokenizer), TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        made = 0

        def flush():
            nonlocal made, held
            bins = best_fit_decreasing([len(x[2]) // 4 for x in held], capacity)
            for k in range(0, len(bins), 256):
                rows = [[held[i] for i in b] for b in bins[k : k + 256]]
                data = [b"".join(x[2] for x in r) for r in rows]
                yield {
                    "sequence_id": [part + made + i for i in range(len(rows))],
                    "n_tokens": [len(x) // 4 for x in data],
                    "input_ids": data,
                    "ids_crc32": [zlib.crc32(x) for x in data],
                    "cu_seqlens": [np.cumsum([0] + [len(x[2]) // 4 for x in r]) for r in rows],
                    "position_starts": [[0 if restart else x[1] for x in r] for r in rows],
                    "doc_ids": [[x[0] for x in r] for r in rows],
                    "doc_starts": [[x[1] for x in r] for r in rows],
                }
                made += len(rows)
            held = []

        n = size = 0
        for batch in slices(batches):
            for d, data in zip(batch.column(0).to_pylist(), encode.many(texts(batch)), strict=True):
                data += end
                held += [(d, k // 4, data[k : k + step]) for k in range(0, len(data), step)]
                n, size = n + 1, size + len(data)
                if n >= docs_at_once or size >= bytes_at_once:
                    yield from flush()
                    n = size = 0
        if held:
            yield from flush()

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def write_packed(sequences: DataFrame, path: str, capacity: int = 4096, pad_id: int = 0) -> None:
    """Writes the id matrix as Parquet: rows padded to ``capacity`` with ``pad_id``, beside lengths and position starts."""
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), capacity - F.col("n_tokens")))
    sequences.withColumn("input_ids", F.concat("input_ids", pad)).write.mode("overwrite").parquet(path)
