"""5. Byte-level BPE: the tiktoken library on a local rank file, pre-split texts, raw-byte decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlace.llm.common import map_arrow, slices, texts

#: A single space or line feed between two characters that are not white space: no match of the pattern spans the place before it.
SAFE = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n][^\s\x1c-\x1f])")


#: Fixed value: the pattern for which SAFE is safe. Texts under any other pattern are not cut.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def presplit(text: str, chars: int = 20_000) -> list[str]:
    """Parts of about ``chars`` characters cut at safe places only; a text without any stays whole."""
    parts, at = [], 0
    while len(text) - at > chars and (m := SAFE.search(text, at + chars)):
        parts.append(text[at : m.start()])
        at = m.start()
    return [*parts, text[at:]]


def encode(enc, text: str, chars: int = 20_000) -> list[int]:
    """The ids of a whole text; it is cut only under PATTERN, where cuts are known to be safe."""
    if len(text) <= chars or enc._pat_str != PATTERN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in presplit(text, chars):
        ids += enc.encode_ordinary(part)
    return ids


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids.

    A null or empty text has no tokens and the hashes of no bytes. Repeated rows keep a row each; other columns are dropped.
    Tasks read the rank file where it is installed on the executor; nothing is shuffled.
    """

    def run(batches):
        enc = encoding(path, pattern)
        for batch in slices(batches):
            out = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if with_ids else {})
            for text in texts(batch):
                ids = encode(enc, text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
            yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def decode_documents(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, data, text): the raw bytes, and their text where they are valid UTF-8 (else null)."""

    def run(batches):
        enc = encoding(path, pattern)
        for batch in slices(batches):
            data = [enc.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            said = []
            for x in data:
                try:
                    said.append(x.decode())
                except UnicodeDecodeError:
                    said.append(None)
            yield {"doc_id": batch.column(0), "data": data, "text": said}

    return map_arrow(ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, data binary, text string")
