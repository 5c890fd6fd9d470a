"""Ids of a tokenizers file, part by part: a memo of parts of words in front of the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np

#: What the quick way takes: spaces, printable ASCII and the composed Latin-1 letters, which normalisation leaves alone but for case.
PLAIN = re.compile(r"[\x20-\x7EÀ-ÖØ-öø-ÿ]*")
#: The file's pre-tokeniser, restricted to those characters in lower case; the alternatives with most matches come first, as only those with an apostrophe overlap.
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9ß-öø-ÿ]+")
#: The pre-tokeniser that PARTS stands for; with any other the quick way is off.
KNOWN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: What the model writes behind the last letter of a part; no part has it in its text, as letters and signs never share one. Without it the quick way is off.
LAST = "</w>"


def byte_letters() -> dict[int, str]:
    """latin-1 code -> the letter that byte-level models write for the byte: itself if printable, else the next from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids, as the library's plain call with add_special_tokens=False does.

    The strings of special tokens in a text give those tokens, as in that call; with ``special_as_text`` they are ordinary text.
    It serves tokenizers whose normaliser and pre-tokeniser never join characters across white space (a split that drops
    white space): the ids of a text are then those of its parts between spaces and line feeds. Stretches of plain words are cut into
    the pre-tokeniser's parts, which go to the library's BPE model directly, all other words through its whole chain. Ids are kept in two
    memos: once the new one holds half of ``most_bytes`` it takes the place of the old one, so memory is bounded and what
    is often used stays; what they give never depends on their state.
    """

    _made: dict = {}

    def __init__(self, path: str, most_bytes: int = 64 << 20, longest: int = 64, special_as_text: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.plain = Tokenizer(self.tokenizer.model)  # the model alone, for parts between spaces
        self.plain.pre_tokenizer = Split(" ", "removed")
        self.letters = {b: x for b, x in byte_letters().items() if b != 32}
        self.room = self.most_room = most_bytes // 2
        self.longest, self.memo, self.old = longest, {}, {}
        with open(path) as f:
            spec = json.load(f)
        self.special = [] if special_as_text else [x["content"] for x in spec.get("added_tokens") or [] if x["content"]]
        self.odd = re.compile("|".join([r"[^\x20-\x7EÀ-ÖØ-öø-ÿ]", *map(re.escape, self.special)]))
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        chain = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.quick = steps[0].get("pattern") == {"Regex": KNOWN} and chain == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[1]["type"] == "ByteLevel"
        vocab = self.tokenizer.get_vocab()
        self.quick &= spec["model"].get("end_of_word_suffix") == LAST and all([x + LAST in vocab for x in self.letters.values()])
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for x, i in vocab.items() if x.endswith(LAST)]] = True

    @classmethod
    def shared(cls, path: str) -> WordEncoder:
        """One for each Python worker and file."""
        return cls._made.get(path) or cls._made.setdefault(path, cls(path))

    def _parts(self, text: str) -> tuple[list[str], set[str]]:
        """Parts whose ids, one after the other, are those of the text, and which of them are whole words; spaces alone divide its words."""
        if not self.quick:
            return (words := text.split(" ")), set(words)
        if PLAIN.fullmatch(text) and not any([x in text for x in self.special]):
            return PARTS.findall(text.lower()), set()
        out: list[str] = []
        whole, at = set(), 0
        while m := self.odd.search(text, at):
            begin, end = text.rfind(" ", at, m.start()) + 1 or at, text.find(" ", m.end())
            end = len(text) if end < 0 else end
            out += PARTS.findall(text[at:begin].lower())
            out.append(text[begin:end])
            whole.add(out[-1])
            at = end
        return out + PARTS.findall(text[at:].lower()), whole

    def _plain_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of each of the pre-tokeniser's parts, in one call of the model."""
        found = self.plain.encode_batch_fast([" ".join(parts).encode().decode("latin-1").translate(self.letters)], add_special_tokens=False)[0]
        ids = np.asarray(found.ids, "<u4")
        data, ends = ids.tobytes(), 4 * np.flatnonzero(self.last[ids]) + 4
        return [data[a:b] for a, b in pairwise([0, *ends.tolist()])]

    def _word_ids(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if self.room < 0:
            self.memo, self.old, self.room = {}, self.memo, self.most_room
        found, new, whole = [], {}, set()
        for text in texts:
            parts, words = self._parts(text.replace("\n", " "))
            ids = list(map(self.memo.get, parts))
            missed = [(i, parts[i]) for i, x in enumerate(ids) if x is None]
            new.update([(p, None) for _, p in missed])
            whole |= words
            found.append((ids, missed))
        for p in new:
            new[p] = self.old.get(p)
        plain = [p for p, x in new.items() if x is None and p not in whole]
        for k in range(0, len(plain), 4096):
            new.update(zip(plain[k : k + 4096], self._plain_ids(plain[k : k + 4096]), strict=True))
        for p, x in new.items():
            if x is None:
                new[p] = x = self._word_ids(p)
            if len(p) <= self.longest:
                self.memo[p] = x
                self.room -= len(p) + len(x) + 200  # both, and their place in the table
        for ids, missed in found:
            for i, p in missed:
                ids[i] = new[p]
            yield b"".join(ids)

    def many(self, texts: Iterable[str], chars: int = 1 << 20) -> Iterator[bytes]:
        """The ids of each text; what the memos lack is encoded at once for about ``chars`` characters, which keeps the model's tables in the cache."""
        group, n = [], 0
        for text in texts:
            group.append(text)
            n += len(text)
            if n >= chars:
                yield from self._group(group)
                group, n = [], 0
        yield from self._group(group)

    def __call__(self, text: str) -> bytes:
        return next(self._group([text]))
