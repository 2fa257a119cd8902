"""Exact tokenisation with a memo of what separate chunks of text encode to.

Both public tokenizer families used here cut a text into pre-tokens by a regular expression and merge
inside a pre-token only. A run of non-space characters (for the byte-level family with the one space
before it) therefore encodes the same wherever it stands, and its ids can be remembered. Natural text
repeats its words, so that most chunks cost one dictionary look-up. Whatever may break the argument
(special strings, white space on which the regular expression engines differ) goes through the
library as a whole text.
"""

from __future__ import annotations

import json
import os
import re

#: Pre-tokenisation that the memo knows: white space dropped, or one space kept with the next word.
DROPPED, KEPT, WHOLE = "dropped", "kept", "whole"
#: White space, or characters next to it, that engines don't agree on.
_UNSURE = re.compile("[\x1c-\x1f\x85᠎​-‍⁠﻿]")
_KEPT = re.compile(r"\s+(?!\S)| ?\S+|\s")
#: A word of plain Latin letters and the marks after it: two pre-tokens in both families.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
#: Chunks that are remembered have at most so many characters, and each generation so many entries.
MEMO_CHARS, MEMO_ENTRIES = 64, 500_000


def _byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {**{b: chr(b) for b in visible}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Memo:
    """A dictionary of bounded size: the older of two generations goes when the younger is full."""

    def __init__(self, entries: int = MEMO_ENTRIES) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.entries = entries

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.entries:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """Encodes whole texts to little-endian 32-bit ids, as the library does without added tokens."""

    def __init__(self, path: str, entries: int = MEMO_ENTRIES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.kind = self._kind(spec)
        self.lower = self.kind == DROPPED
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in [32, *range(192, 256)]}
        self.model = self.tokenizer.model
        self.packed = [i.to_bytes(4, "little") for i in range(self.vocabulary_size())]
        self.memo = Memo(entries)

    @staticmethod
    def _kind(spec: dict) -> str:
        normal, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        if normal is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return KEPT
        steps = [n["type"] for n in (normal or {}).get("normalizers", [])]
        inner = pre.get("pretokenizers", [{}])
        if steps == ["NFC", "Replace", "Lowercase"] and inner[0].get("behavior") == "Removed" and inner[0].get("invert"):
            return DROPPED
        return WHOLE

    def vocabulary_size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        packed = self.packed
        return b"".join([packed[i] for i in ids])

    def _plain_word(self, word: str) -> bytes:
        """A pre-token of Latin letters: only the merges are left to do."""
        if self.lower:
            word = word.lower()
        if not word.isascii():
            seen = word.translate(self.letters)
        else:
            seen = "\u0120" + word[1:] if word[0] == " " else word
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(seen)])

    def _merged(self, chunk: str) -> bytes:
        """The ids of a chunk that is not in the memo. A word before marks is looked up, and remembered, by itself."""
        if len(chunk) > MEMO_CHARS or not (m := _PLAIN.fullmatch(chunk)):
            return self._library(chunk)
        word, marks = m.groups()
        return self.chunk(word) + self.chunk(marks) if marks else self._plain_word(word)

    def chunk(self, chunk: str) -> bytes:
        """The ids of one chunk."""
        memo = self.memo
        ids = memo.young.get(chunk)
        if ids is None:
            ids = memo.old.get(chunk)
            if ids is None:
                ids = self._merged(chunk)
            if len(chunk) <= MEMO_CHARS:
                memo.put(chunk, ids)
        return ids

    def chunks(self, text: str) -> list[str] | None:
        """Parts of the text that encode separately; None if only the whole text is sure."""
        if self.kind == WHOLE or _UNSURE.search(text) or any(s in text for s in self.special):
            return None
        return text.split() if self.kind == DROPPED else _KEPT.findall(text)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        parts = self.chunks(text)
        if parts is None:
            return self._library(text)
        found = list(map(self.memo.young.get, parts))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = self.chunk(parts[at])
        return b"".join(found)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, entries: int = MEMO_ENTRIES) -> Encoder:
    """The encoder of this Python worker for a vocabulary file and a size of memo."""
    if (path, entries) not in _encoders:
        _encoders[path, entries] = Encoder(path, entries)
    return _encoders[path, entries]
