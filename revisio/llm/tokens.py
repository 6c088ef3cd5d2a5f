"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

The merges are applied with a pair occurrence index: each pair of neighbouring
symbols points to all its positions among the new words of a batch, active
ranks are taken in ascending order, and the neighbours of each merged pair are
entered under their new pairs.  Words of a text are the pieces that the
vocabulary's pattern cuts; equal words are merged once for a worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that cuts a text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker remembers between batches; beyond it the memory is emptied, which changes no result.
REMEMBERED = 200_000

_coders: dict[int, "PairIndexCoder"] = {}


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairIndexCoder:
    """Merges words by a pair occurrence index over all words of a batch."""

    def __init__(self, model: str) -> None:
        bpe = json.loads(model)["model"]
        vocab = bpe["vocab"]
        self.first = [vocab[c] for _, c in sorted(byte_symbols().items())]
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(bpe["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def merge(self, words: list[str]) -> None:
        """Enters the ids of ``words`` into ``known``."""
        first, ranks = self.first, self.ranks
        sym: list[int] = []
        starts: list[int] = []
        for w in words:
            starts.append(len(sym))
            sym += [first[b] for b in w.encode("utf-8")]
            sym.append(-1)  # a wall that no pair crosses
        size = len(sym)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        at: dict[int, list[int]] = {}
        for i in range(size - 1):
            if sym[i] >= 0 <= sym[i + 1]:
                at.setdefault(sym[i] << 32 | sym[i + 1], []).append(i)
        active = [(*ranks[p], p) for p in at if p in ranks]
        heapq.heapify(active)
        while active:
            _, new, pair = heapq.heappop(active)
            a, b = pair >> 32, pair & 0xFFFFFFFF
            for i in sorted(at.pop(pair, ())):
                j = after[i]
                if sym[i] != a or j >= size or sym[j] != b:
                    continue  # a merge before it took one of its symbols
                sym[i], sym[j] = new, -2
                k = after[i] = after[j]
                if k < size:
                    before[k] = i
                for x, y in ((before[i], i), (i, k)):
                    if x >= 0 and y < size and sym[x] >= 0 <= sym[y]:
                        key = sym[x] << 32 | sym[y]
                        if key in ranks:
                            if key not in at:
                                at[key] = []
                                heapq.heappush(active, (*ranks[key], key))
                            at[key].append(x)
        for w, s, e in zip(words, starts, [*starts[1:], size]):
            self.known[w] = [t for t in sym[s : e - 1] if t >= 0]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all ``texts``; empty and null texts have no ids."""
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for words in cut for w in words} - self.known.keys())
        if new:
            self.merge(new)
        known = self.known
        flat: list[int] = []
        ends = [0]
        for words in cut:
            for w in words:
                flat += known[w]
            ends.append(len(flat))
        return np.array(ends, dtype=np.int32), np.array(flat, dtype=np.int32)


def encode_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, ids array<int>)`` of every row.

    Null and empty texts give an empty list; blank texts give the ids of their
    blanks.  Repeated ids and texts give a row each; other columns are ignored;
    strings of special tokens in a text are ordinary text.  The vocabulary, a
    file of fixed size (1.6 MB), is read once on the driver and broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text("utf-8"))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = model.value
        if hash(text) not in _coders:
            _coders[hash(text)] = PairIndexCoder(text)
        coder = _coders[hash(text)]
        for batch in batches:
            for s in range(0, batch.num_rows, 512):  # bounds the Python lists of long texts
                part = batch.slice(s, 512)
                ends, flat = coder.encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    out = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out).withColumnRenamed("id", id_col)
