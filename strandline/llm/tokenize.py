"""Encoding of a corpus by a public byte-level BPE tokenizer, in batched merge rounds.

The words of a batch are laid out in one flat array of symbols. In each round
every adjacent pair is looked up by binary search over the sorted pair keys of
the merge table, each word's lowest-ranked pair is merged everywhere in that
word, and words without a pair left are taken out. Each distinct word of a
worker is merged once and kept in a bounded cache.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the tokenizer files, described in its README.
DEFAULT_FOLDER = os.environ.get("STRANDLINE_TOKENIZERS", "/opt/tokenizers")
DEFAULT_TOKENIZER = "byte_bpe_50k"
#: Fixed value: the public pattern that splits text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words a worker keeps before it starts afresh.
CACHE_WORDS = 300_000

_SHIFT = 20
_NONE = np.int64(1 << 40)


@dataclass
class MergeTable:
    """Sorted pair keys with the rank and the id that each pair merges to, and the id of each byte."""

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    byte_ids: np.ndarray


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [letters[b] for b in range(256)]


def load_merges(name: str = DEFAULT_TOKENIZER, folder: str = DEFAULT_FOLDER) -> MergeTable:
    """The merge table of a byte-level BPE vocabulary file (``name``.json)."""
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
    right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    keys = left << _SHIFT | right
    order = np.argsort(keys, kind="stable")
    return MergeTable(keys[order], order.astype(np.int64), merged[order], np.array([vocab[c] for c in _byte_letters()], dtype=np.int64))


def merge_words(words: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in one array, and where each word starts (with the end at last)."""
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    symbols = table.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), lengths)
    done_symbols, done_owner = [], []
    last = len(table.keys) - 1
    while len(symbols):
        same = owner[1:] == owner[:-1]
        key = symbols[:-1] << _SHIFT | symbols[1:]
        at = np.minimum(np.searchsorted(table.keys, key), last)
        rank = np.full(len(symbols), _NONE)
        hit = same & (table.keys[at] == key)
        rank[:-1][hit] = table.ranks[at[hit]]
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(symbols)))
        live = np.repeat(least < _NONE, sizes)
        if not live.all():
            done_symbols.append(symbols[~live])
            done_owner.append(owner[~live])
        take = live & (rank == np.repeat(least, sizes))
        # In a run of equal symbols every other pair merges, counted from the left.
        place = np.flatnonzero(take)
        if not len(place):
            break
        fresh = np.concatenate(([True], np.diff(place) != 1))
        run_start = place[fresh][np.cumsum(fresh) - 1]
        place = place[(place - run_start) % 2 == 0]
        symbols = symbols.copy()
        symbols[place] = table.merged[np.searchsorted(table.keys, symbols[place] << _SHIFT | symbols[place + 1])]
        keep = live
        keep[place + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    all_owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
    all_symbols = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
    order = np.argsort(all_owner, kind="stable")
    counts = np.bincount(all_owner, minlength=len(words))
    return all_symbols[order].astype(np.int32), np.concatenate(([0], np.cumsum(counts)))


class Encoder:
    """Encodes batches of texts, merging each distinct word once."""

    def __init__(self, table: MergeTable, cache_words: int = CACHE_WORDS):
        self.table = table
        self.cache_words = cache_words
        self.split = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and the offsets of each text; none for a null or empty text."""
        if len(self.number) > self.cache_words or len(self.ids) > 16 * self.cache_words:
            self._forget()
        number = self.number
        per_text = [self.split(t) if t else [] for t in texts]
        known = len(number)
        for words in per_text:
            for w in set(words):
                if w not in number:
                    number[w] = len(number)
        if len(number) > known:
            new = list(number)[known:]
            ids, starts = merge_words([w.encode("utf-8", "surrogatepass") for w in new], self.table)
            self.offsets = np.concatenate((self.offsets, starts[1:] + len(self.ids)))
            self.ids = np.concatenate((self.ids, ids))
        n_words = np.fromiter((len(w) for w in per_text), np.int64, len(per_text))
        which = np.fromiter((number[w] for words in per_text for w in words), np.int64, int(n_words.sum()))
        lengths = self.offsets[which + 1] - self.offsets[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.offsets[which] - (ends - lengths), lengths) + np.arange(total)
        word_ends = np.concatenate(([0], ends))
        text_offsets = word_ends[np.concatenate(([0], np.cumsum(n_words)))]
        return self.ids[source], text_offsets


def _encoded(df: DataFrame, key: str, text: str, schema: str, emit, name: str, folder: str) -> DataFrame:
    table = df.sparkSession.sparkContext.broadcast(load_merges(name, folder))  # a fixed vocabulary, 2 MB

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(table.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, offsets = encoder.batch(part.column(1).to_pylist())
                yield emit(part.column(0), ids, offsets)

    return df.select(key, text).mapInArrow(run, schema)


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = DEFAULT_TOKENIZER, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """``key`` and ids (array of int): the token ids of ``text``, without special tokens.

    An empty list for a null or empty text; a blank text is encoded as it
    stands; strings that spell a special token are ordinary text. One row per
    input row, repeated keys and null keys included; other columns are
    dropped. Texts are whole, however long. No shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def emit(keys, ids, offsets):
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))], [key, "ids"])

    return _encoded(df, key, text, f"`{key}` {kind}, ids array<int>", emit, name, folder)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = DEFAULT_TOKENIZER, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """``key`` and n_tokens (bigint), 0 for a null or empty text; otherwise as ``token_ids``."""
    kind = df.schema[key].dataType.simpleString()

    def emit(keys, ids, offsets):
        return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(offsets), pa.int64())], [key, "n_tokens"])

    return _encoded(df, key, text, f"`{key}` {kind}, n_tokens bigint", emit, name, folder)
