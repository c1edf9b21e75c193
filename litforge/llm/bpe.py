"""Byte-pair encoding with word ends, and decoding.

A word is merged with a heap of (rank, position) over a doubly linked list of
symbols: the best pair is popped, entries whose symbols have changed meanwhile
are skipped, and the pairs on both sides of a merge are pushed.  That takes
n log n steps for a word of n bytes.  Decoding joins vocabulary strings.  Plain
ASCII is lowered and cut into words here; elsewhere the vocabulary's own
normalizer and pre-tokenizer do so, whose Unicode tables differ from Python's.

Encoded words are remembered per worker up to CACHE entries; the memory is then
emptied, so it stays bounded whatever the corpus.

Cases: null text is empty and gives no ids; a text of any length is encoded
whole; special tokens in a text are recognised as such; repeated rows give
repeated results; other columns are dropped, whatever their names; an empty table
gives no rows; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from litforge.session import table

VOCABULARY = "word_bpe_49k.json"
#: Words and space-separated chunks remembered by a worker.
CACHE = 400_000

#: ASCII's white space, and the pattern of the vocabulary's pre-tokenizer for ASCII.
WHITE = "\t\n\x0b\x0c\r "
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in shown else spare))
        spare += b not in shown
    return letters


class Memory(dict):
    """``key -> make(key)``, emptied when full."""

    def __init__(self, make, most: int = CACHE):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class WordBpe:
    """A lower-casing BPE whose last symbol of a word carries a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.suffix = model["end_of_word_suffix"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.pieces = re.compile(WORD, re.ASCII)
        self.blank = {ord(c): " " for c in WHITE}
        self.splitter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words = Memory(self.merge)
        self.chunks = Memory(self.chunk)

    def chunk(self, chunk: str) -> bytes:
        """Ids of what stands between two blanks."""
        if chunk.isascii() and chunk.isprintable():
            return b"".join(map(self.words.__getitem__, self.pieces.findall(chunk)))
        return b"".join(self.words[word] for word, _ in self.split(chunk))

    def merge(self, word: str) -> bytes:
        """Ids of a word of byte letters as little-endian unsigned 32-bit integers."""
        symbols = list(word)
        symbols[-1] += self.suffix
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(found[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: a neighbour has been merged since
            ids[i], ids[j] = merges[left, right][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (found[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (found[0], h, ids[h], ids[i]))
        return array("I", [i for i in ids if i >= 0]).tobytes()

    def _plain(self, text: str) -> bytes:
        plain = text.lower().translate(self.blank) if text.isascii() else self.normalize(text)
        return b"".join(map(self.chunks.__getitem__, filter(None, plain.split(" "))))

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text:
            return self._plain(text)
        return b"".join(array("I", [self.special[part]]).tobytes() if part in self.special else self._plain(part) for part in self.splitter.split(text))

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by a space, as a vocabulary without a decoder is decoded."""
        return " ".join(map(self.strings.__getitem__, ids))


_MODELS: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    """The vocabulary at ``path``, read once in each worker."""
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


def encode_table(docs: DataFrame, path: str | None = None, keep_ids: bool = True, digests: bool = False) -> DataFrame:
    """``doc_id, n_tokens`` of every row, with ``ids`` and with digests of ids and decoded text on request."""
    fields = [("doc_id", pa.int64(), "long"), ("n_tokens", pa.int64(), "long")]
    fields += [("ids", pa.list_(pa.int32()), "array<int>")] * keep_ids
    fields += [("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")] * digests
    schema = pa.schema([f[:2] for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path or public_tokenizers.path(VOCABULARY))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, len(batch), 500):
                out: dict[str, list] = {f[0]: [] for f in fields}
                for text in texts.slice(at, 500):
                    data = bpe.encode_bytes(text.as_py())
                    ids = array("I", data)
                    out["n_tokens"].append(len(ids))
                    if keep_ids:
                        out["ids"].append(ids.tolist())
                    if digests:
                        out["ids_sha256"].append(hashlib.sha256(data).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                out["doc_id"] = keys.slice(at, 500)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name != "doc_id" else out["doc_id"].cast(f.type) for f in schema], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{f[0]} {f[2]}" for f in fields))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(table(spark, sf_dir, "documents"), keep_ids=False, digests=True)


QUERIES = {"op2_bpe": op2_bpe}
ORACLE_SQL: dict[str, str] = {}
