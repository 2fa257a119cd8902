"""Token counts with a whole-token shortcut.

Which strings of a vocabulary encode alone as one token is proved beforehand, with the library's own
merges. A pre-token among them counts one without any merge; only the other pre-tokens are merged, and
what they come to is remembered. Text that cannot be cut into pre-tokens safely is counted whole by
the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import documents
from docloom.llm.tokens import DROPPED, MEMO_CHARS, MEMO_ENTRIES, _PLAIN, KEPT, _byte_letters, encoder


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary's strings that are one pre-token and are proved to encode alone as one token.

    For the family that drops white space these are lower-case words and marks; for the byte-level
    family a string may begin with its space. Strings of other vocabularies are not proved: empty set.
    """
    e = encoder(path)
    if e.kind not in (DROPPED, KEPT):
        return frozenset()
    to_byte = {c: b for b, c in _byte_letters().items()}
    proved = set()
    for token in e.tokenizer.get_vocab(with_added_tokens=False):
        letters = token.removesuffix("</w>") if e.kind == DROPPED else token
        try:
            text = bytes(to_byte[c] for c in letters).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        m = _PLAIN.fullmatch(text)
        plain = m is not None and not m[2] and text == (text.lower() if e.kind == DROPPED else text)
        if plain and len(text) <= MEMO_CHARS and len(e.model.tokenize(letters)) == 1:
            proved.add(text)
    return frozenset(proved)


class Counter:
    """Counts tokens of whole texts: proved strings directly, the rest by merges."""

    def __init__(self, path: str, proved: frozenset[str]) -> None:
        self.encoder = encoder(path)
        self.proved = proved
        self.young = dict.fromkeys(proved, 1)
        self.old: dict[str, int] = {}

    def _pre_token(self, word: str) -> int:
        seen = word.lower() if self.encoder.lower else word
        return 1 if seen in self.proved else len(self.encoder._plain_word(word)) // 4

    def _chunk(self, chunk: str) -> int:
        n = self.old.get(chunk)
        if n is None:
            if (m := _PLAIN.fullmatch(chunk)) and len(chunk) <= MEMO_CHARS:
                n = self._pre_token(m[1])
                if m[2]:
                    known = self.young.get(m[2])
                    n += self._chunk(m[2]) if known is None else known
            else:
                n = len(self.encoder._library(chunk)) // 4
        if len(chunk) <= MEMO_CHARS:
            if len(self.young) >= MEMO_ENTRIES + len(self.proved):
                self.old, self.young = self.young, dict.fromkeys(self.proved, 1)
            self.young[chunk] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = self.encoder.chunks(text)
        if parts is None:
            return len(self.encoder._library(text)) // 4
        found = list(map(self.young.get, parts))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            n = self.young.get(parts[at])
            found[at] = self._chunk(parts[at]) if n is None else n
        return sum(found)


_counters: dict[str, Counter] = {}


def _pieces(path: str):
    """Counting by the sentencepiece library, for .model files."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(model.encode(text, num_threads=1)) if text else 0


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens; very long texts are counted whole; repeated rows
    give repeated results; an empty table gives an empty one; other columns are not read. One pass, no
    shuffle. What is broadcast is the set of proved strings, never more than the vocabulary.
    """
    library = path.endswith(".model")
    proved = docs.sparkSession.sparkContext.broadcast(frozenset() if library else whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = _pieces(path) if library else Counter(path, proved.value).count
        count = _counters[path]
        for batch in batches:
            n = pa.array([count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = documents(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
