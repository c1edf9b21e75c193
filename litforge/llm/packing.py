"""Best-fit packing of documents into sequences of a fixed number of tokens.

Hierarchical: every partition packs its own pieces by best fit, largest first,
and emits bins that are nearly full.  Underfull bins go up a level as single
items of their fill, are dealt anew to fewer partitions, and are packed again;
at most ITEMS items meet in a task.  The levels end when one task has held all
that is left, or when a level no longer saves bins.

A bin carries its members as packed binary, so that no level needs a join.

Cases: null or empty text is the single closing token; documents that are longer
than a sequence are cut so that only the first piece may be short; repeated rows
are packed once each; an empty table gives no rows; a null doc_id stays null; texts of
any length are encoded whole, one at a time; other columns are dropped, whatever
their names.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from litforge.llm.bpe import Memory, byte_letters
from litforge.session import materialize, table

VOCABULARY = "byte_bpe_50k.json"
#: Production parameters.
CAPACITY = 2048
#: A bin of this share of the capacity is emitted at once; others are tried again.
NEARLY_FULL = 0.995
#: Items of one task above the first level.
ITEMS = 20_000
CACHE = 500_000

#: White space other than single blanks and line feeds.
UNEVEN = ("  ", " \n", "\n ", "\n\n", *(chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

MEMBER = np.dtype([("doc_id", "<i8"), ("known", "i1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4"), ("offset", "<i4")])
BINS = "bin long, fill int, members binary, done boolean"
_BINS = pa.schema([("bin", pa.int64()), ("fill", pa.int32()), ("members", pa.binary()), ("done", pa.bool_())])


class Encoder:
    """Ids of a text as the library gives them, with a memory for what stands between spaces.

    Where every white space is a single blank or line feed between other
    characters, the pre-tokenizer cuts before each of them and after each line
    feed, so what stands between can be encoded by itself.  Other texts are
    encoded whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = self._pieces(path)
        self.feed = self._ids("\n")
        self.heads = Memory(self._piece, CACHE)
        self.inner = Memory(lambda chunk: self._piece(" " + chunk), CACHE)

    @staticmethod
    def _pieces(path: str) -> tiktoken.Encoding | None:
        """The same vocabulary for single words: quicker to call where ids follow the order of merges."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        code = {c: b for b, c in enumerate(byte_letters())}
        merged = [model["vocab"][a + b] for a, b in model["merges"]]
        if merged != sorted(merged) or model.get("ignore_merges"):
            return None
        ranks = {bytes(code[c] for c in token): i for token, i in model["vocab"].items() if all(c in code for c in token)}
        return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, text: str) -> bytes:
        return array("I", self.pieces.encode_ordinary(text)).tobytes() if self.pieces else self._ids(text)

    def encode_bytes(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0].isspace() or text[-1].isspace() or any(t in text for t in UNEVEN) or any(t in text for t in self.special):
            return self._ids(text)
        out: list[bytes] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(self.heads[first])
            out.extend(map(self.inner.__getitem__, rest))
            out.append(self.feed)
        out.pop()
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Indexes of the items of each bin.  Largest item first, into the bin that it fills best.

    Bins wait in stacks by residual; an integer's bits say which stacks aren't empty.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits, bins = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = open_bits >> size
        if above:
            residual = size + (above & -above).bit_length() - 1
            b = stacks[residual].pop()
            if not stacks[residual]:
                open_bits &= ~(1 << residual)
        else:
            residual, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := residual - size:
            stacks[left].append(b)
            open_bits |= 1 << left
    return bins


def _emit(bins: list[tuple[int, bytes]], level: int, capacity: int, last: bool) -> Iterator[pa.RecordBatch]:
    base = level << 56 | TaskContext.get().partitionId() << 32
    for at in range(0, len(bins), 2000):
        part = bins[at : at + 2000]
        ids = list(range(base + at, base + at + len(part)))
        done = [last or fill >= NEARLY_FULL * capacity for fill, _ in part]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f for f, _ in part], pa.int32()), pa.array([m for _, m in part], pa.binary()), pa.array(done, pa.bool_())], schema=_BINS)


def _join(items: list[tuple[int, bytes]], capacity: int) -> list[tuple[int, bytes]]:
    """Bins of items; the offsets of members move with their item."""
    sizes = np.array([f for f, _ in items], np.int64)
    out = []
    for chosen in best_fit(sizes, capacity):
        if len(chosen) == 1:
            out.append(items[chosen[0]])
            continue
        members, fill = [], 0
        for i in chosen:
            m = np.frombuffer(items[i][1], MEMBER).copy()
            m["offset"] += fill
            members.append(m.tobytes())
            fill += items[i][0]
        out.append((fill, b"".join(members)))
    return out


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be short."""
    first = total % capacity or capacity
    return [(0, min(first, total))] + [(s, capacity) for s in range(first, total, capacity)]


def _first_level(capacity: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or public_tokenizers.path(VOCABULARY)).encode_bytes
        short: list[tuple[int, bytes]] = []
        whole: list[tuple[int, bytes]] = []
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + b"\0\0\0\0")
                doc = key.as_py()
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    member = np.array([(doc or 0, doc is not None, piece, start, length, crc, 0)], MEMBER).tobytes()
                    (short if length < capacity else whole).append((length, member))
        yield from _emit(whole + _join(short, capacity), 0, capacity, False)

    return run


def _next_level(capacity: int, level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [(f.as_py(), m.as_py()) for batch in batches for f, m in zip(batch.column(0), batch.column(1), strict=True)]
        yield from _emit(_join(items, capacity), level, capacity, last)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """A row per piece of every row of ``docs(doc_id, text)`` with its place in a sequence."""
    level = 0
    found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_first_level(capacity, path), BINS)
    found = materialize(found, f"packing-{level}")
    done = found.filter("done")
    items = found.filter("NOT done").count()
    last = False
    while items and not last:
        level += 1
        parts = -(-items // ITEMS)
        last = parts == 1
        rest = found.filter("NOT done").select("fill", "members").repartition(parts)
        found = materialize(rest.mapInArrow(_next_level(capacity, level, last), BINS), f"packing-{level}")
        done = done.unionByName(found.filter("done"))
        before, items = items, 0 if last else found.filter("NOT done").count()
        if items > 0.98 * before:
            done, last = done.unionByName(found.filter("NOT done")), True
    return done.select("bin", "members").mapInArrow(_spread, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            blobs = part.column(1).to_pylist()
            m = np.frombuffer(b"".join(blobs), MEMBER)
            bins = np.repeat(part.column(0).to_numpy(), [len(b) // MEMBER.itemsize for b in blobs])
            columns = [pa.array(m["doc_id"].copy(), mask=m["known"] == 0), pa.array(m["piece"].copy())]
            columns += [pa.array(x.astype(np.int64)) for x in (m["start"], m["length"], m["crc"], bins, m["offset"])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
ORACLE_SQL: dict[str, str] = {}
