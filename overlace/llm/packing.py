"""4. Packing: first-fit decreasing on a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.llm.common import map_arrow, slices, texts
from overlace.llm.wordtok import WordEncoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ticket long"


class TournamentTree:
    """Free room of bins 0..n-1 in a complete binary tree of maxima; the first bin with enough room in O(log n)."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        best, k = self.best, 1
        while k < self.size:
            k *= 2
            if best[k] < need:
                k += 1
        return k - self.size

    def take(self, bin_: int, need: int) -> None:
        best, k = self.best, bin_ + self.size
        best[k] -= need
        while k > 1:
            k >>= 1
            now = max(best[2 * k], best[2 * k + 1])
            if best[k] == now:
                return
            best[k] = now


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, which is 1..capacity; longest first, ties in the order given."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    tree = TournamentTree(max(1, n), capacity)
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        b = tree.first_fit(need)
        offsets[i], bins[i] = capacity - tree.best[b + tree.size], b
        tree.take(b, need)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece of a document of its ids and ``end_id``: full pieces of ``capacity`` ids, then the rest.

    A null text is empty, so its document has the end id alone. ticket is a random number for dealing pieces to groups; it depends on the
    place of the row in the input only, so repeated rows and equal ids spread, and a task that runs again draws the same.
    """
    step, end = 4 * capacity, int(end_id).to_bytes(4, "little")

    def run(batches):
        encode = WordEncoder.shared(tokenizer)
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in slices(batches):
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for d, data in zip(ids, encode.many(texts(batch)), strict=True):
                data += end
                out += [(d, k // 4, min(step, len(data) - k) // 4, zlib.crc32(data[k : k + step]), len(data) // 4) for k in range(0, len(data), step)]
            cols = list(zip(*out, strict=True))
            yield dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), cols, strict=True)) | {"ticket": rng.integers(0, 1 << 62, len(out))}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, docs_per_group: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Pieces are dealt at random to groups of about ``docs_per_group`` documents; each group is packed alone by
    first-fit decreasing, so a task never holds more than a group of piece lengths, and no text or id is shuffled.
    sequence_id is the group's number and the bin's. Documents without text, repeated rows and null ids
    get pieces like all others; an empty table gives no rows.
    """
    n_groups = max(1, -(-docs.count() // docs_per_group))
    dealt = pieces(docs, tokenizer, capacity, end_id).withColumn("group", F.col("ticket") % n_groups)

    def per_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ticket", "doc_id", "start"], kind="stable", ignore_index=True)
        bins, rows["offset"] = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = (rows["group"].to_numpy(np.int64) << 32) | bins
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return dealt.groupBy("group").applyInPandas(per_group, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
