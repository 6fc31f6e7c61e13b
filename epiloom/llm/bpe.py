"""Encoding with the rank file of a public byte-level BPE tokenizer, by numpy merge rounds over many words at once.

The texts are split by the tokenizer's pattern; each distinct word of a batch is encoded once. The byte symbols of all
new words lie in one flat array. In a round, the ranks of all neighbouring pairs are found by binary search over the
sorted pair keys, each word's lowest-ranked pairs are merged, and words without a pair left are taken out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie on this machine; only the driver reads them.
TOKENIZERS = "/opt/tokenizers"
#: The pattern that splits texts before the merges of these vocabularies (a fixed value of the public files).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words a task remembers; beyond, it forgets them all and goes on.
REMEMBERED = 200_000
#: Characters of text that are split and encoded at once.
AT_ONCE = 2_000_000
NONE = np.iinfo(np.int64).max


class RankTable:
    """A vocabulary as sorted pair keys (left id << 32 | right id) and the ids of their merges."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [(ranks[w[:i]] << 32 | ranks[w[i:]], n) for w, n in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks]
        pairs.sort()
        self.keys, self.ids = (np.array(x, dtype=np.int64) for x in zip(*pairs))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], NONE)


def encode_words(table: RankTable, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all ``words`` (none empty) in one array, and the number of ids of each word."""
    symbol = table.bytes[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        rank = np.full(len(symbol), NONE)
        rank[:-1] = np.where(word[1:] == word[:-1], table.ranks(symbol[:-1], symbol[1:]), NONE)
        head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(head, len(word)))
        least = np.repeat(np.minimum.reduceat(rank, head), size)
        over = least == NONE
        if over.any():
            done.append((word[over], symbol[over]))
            symbol, word, rank, least = symbol[~over], word[~over], rank[~over], least[~over]
            if not len(symbol):
                break
        hit = rank == least
        # Of hits in a row, which share symbols, every other one from the left is merged.
        fresh = hit & ~np.append(False, hit[:-1])
        place = np.arange(len(hit))
        hit &= (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
        symbol[hit] = rank[hit]
        stay = ~np.append(False, hit[:-1])
        symbol, word = symbol[stay], word[stay]
    if not done:
        return np.empty(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
    word, symbol = (np.concatenate(x) for x in zip(*done))
    return symbol[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes texts, remembering the words it has met."""

    def __init__(self, table: RankTable) -> None:
        self.table, self.split = table, regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at, self.n = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts, every one of them encoded, and each text's count of words."""
        if len(self.known) > REMEMBERED:
            self.forget()
        before, known = len(self.known), self.known
        numbers: list[int] = []
        counts = np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            found = self.split(text)
            counts[i] = len(found)
            numbers += [known.setdefault(w, len(known)) for w in found]
        new = [w.encode("utf-8", "surrogatepass") for w in list(known)[before:]]
        if new:
            ids, n = encode_words(self.table, new)
            self.at = np.append(self.at, len(self.ids) + np.cumsum(n) - n)
            self.n = np.append(self.n, n)
            self.ids = np.append(self.ids, ids)
        return np.array(numbers, dtype=np.int64), counts

    def lengths(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        numbers, counts = self.words(texts)
        return _sums(self.n[numbers], counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each text."""
        numbers, counts = self.words(texts)
        n = self.n[numbers]
        start = np.cumsum(n) - n
        where = np.arange(n.sum()) + np.repeat(self.at[numbers] - start, n)
        return self.ids[where], _sums(n, counts)


def _sums(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    cum = np.append(0, np.cumsum(n))
    ends = np.cumsum(counts)
    return cum[ends] - cum[ends - counts]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batch of about AT_ONCE characters, with their texts; NULL reads as empty."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    a, held = 0, 0
    for z, t in enumerate(texts, 1):
        held += len(t)
        if held >= AT_ONCE or z == len(texts):
            yield batch.slice(a, z - a), texts[a:z]
            a, held = z, 0


def _run(table, make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(table.value)
        for batch in batches:
            for part, texts in _parts(batch):
                yield make(encoder, part, texts)

    return run


def _ids(encoder: Encoder, part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    ids, n = encoder.encode(texts)
    offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
    return pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["id", "ids"])


def _counts(encoder: Encoder, part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([part.column("id"), pa.array(encoder.lengths(texts))], ["id", "n_tokens"])


def _apply(df: DataFrame, id_: str, text: str, vocabulary: str, tokenizers: str, make, column: str) -> DataFrame:
    # The table is a fixed file of a public tokenizer (50,256 ranks here), whatever the data.
    table = df.sparkSession.sparkContext.broadcast(RankTable(f"{tokenizers}/{vocabulary}.tiktoken"))
    kind = df.select(id_).schema[0].dataType.simpleString()
    out = df.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_run(table, make), f"id {kind}, {column}")
    return out.withColumnRenamed("id", id_)


def token_ids(df: DataFrame, id_: str, text: str, vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(id, ids ARRAY<INT>): the token ids of each whole text, without special tokens, in the input's partitions.

    NULL and empty texts have an empty list of ids. Strings of special tokens in a text are ordinary text. Repeated rows
    and NULL ids come out as they come in; other columns aren't read.
    """
    return _apply(df, id_, text, vocabulary, tokenizers, _ids, "ids ARRAY<INT>")


def token_counts(df: DataFrame, id_: str, text: str, vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """(id, n_tokens BIGINT): the number of :func:`token_ids` of each text; 0 for NULL and empty texts."""
    return _apply(df, id_, text, vocabulary, tokenizers, _counts, "n_tokens BIGINT")
