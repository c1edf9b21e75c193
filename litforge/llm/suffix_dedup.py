"""Removal of passages that occur more than once, by suffix sorting.

Every byte covered by a string of LENGTH bytes that also starts anywhere else
goes.  The corpus is cut into shards such that equal strings meet:

1. A window of LENGTH bytes is known by the smallest hash among its GRAM-byte
   substrings, its mark.  Equal windows have equal marks, wherever they stand.
   Neighbouring windows mostly share a mark, so a text has about one run of
   windows per 70 bytes.
2. Marks are dealt to buckets as packed records; only runs whose mark occurs
   again stay.  That loses nothing: a repeated window has a repeated mark.
3. The bytes of these runs go to the shard of their mark.  Equal contents are
   held once; a shard's suffixes are sorted by external induced sorting, which
   gives their common prefixes too, and neighbours in that order that have LENGTH
   bytes in common are repeated starts.  A shard is read in pieces; its text and
   the queues move to files of the shared folder beyond MEMORY.  All runs of one
   mark are in one shard.
4. Starts become spans of their texts, which are cut.

Texts are known by a 64-bit hash, so copies are marked by counting alone: copies
of LENGTH bytes or more go wholly, and one of them stands for all in the above.

Cases: null text is empty; texts under LENGTH bytes keep all bytes; repeated
rows are copies; a null doc_id stays null; matches never cross documents; texts
of any length are read whole; an empty table gives no rows; ``remove_repeats`` keeps
all columns, of any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.llm.joins import hot_keys, with_facts
from litforge.llm.suffix_sort import Scratch, repeated_starts
from litforge.session import materialize, release, shared_dir, table

#: Production parameters.
LENGTH = 200
GRAM = 64
#: Bytes of run contents that a shard is laid out for, and of marks for a bucket.
SHARD_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
#: Bytes of contents that a task holds before it deals them to shards.
CUT_BYTES = 16 << 20
#: Bytes of tuples and texts that sorting a shard holds in memory, about; the rest is in files of the shared folder.
MEMORY = 256 << 20
#: Up to so many ids (16 MB) pick rows by broadcast; beyond, by a shuffled join.
BROADCAST_IDS = 1_000_000
EMPTY = hashlib.sha256(b"").hexdigest()

RUN = np.dtype([("mark", "<u8"), ("key", "<i8"), ("start", "<u4"), ("run", "<u4"), ("tie", "<u4"), ("size", "<u4")])
SPAN = np.dtype([("key", "<i8"), ("from", "<u4"), ("to", "<u4")])
_PACKED = pa.schema([("part", pa.int32()), ("data", pa.binary())])
PACKED = "part int, data binary"

_LETTERS = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def runs_of(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mark, start, number of windows, tie) of each run of windows with one mark.

    ``tie``: the mark stands twice within a window, so the run may repeat itself.
    ``gram`` is a power of two.
    """
    h = _LETTERS[np.frombuffer(data, np.uint8)]
    width, i = 1, 0
    while width < gram:
        h = h[:-width] * _FACTORS[i] + h[width:]
        width, i = 2 * width, i + 1
    h = (h ^ (h >> np.uint64(31))) * _FACTORS[6]
    h ^= h >> np.uint64(29)
    w, m, width = length - gram + 1, h, 1
    while 2 * width <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if rest := w - width:
        m = np.minimum(m[:-rest], m[rest:])
    changed = m[1:] != m[:-1]
    starts = np.concatenate(([0], np.flatnonzero(changed) + 1))
    twice = np.zeros(len(m), bool)
    twice[:-1] = (h[: len(m) - 1] == m[:-1]) & ~changed
    return m[starts], starts, np.diff(np.append(starts, len(m))), np.logical_or.reduceat(twice, starts)


def _deal(records: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Records packed by part."""
    order = np.argsort(part, kind="stable")
    records, part = records[order], part[order]
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    bounds = np.concatenate(([0], cuts, [len(part)]))
    if len(part):
        blobs = [records[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], schema=_PACKED)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    x = key.view("<u8") if key.dtype != np.uint64 else key
    return ((x >> np.uint64(17)) % np.uint64(parts)).astype(np.int32)


def _mark_texts(length: int, gram: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) < length or key in seen:
                    continue
                if len(seen) < 500_000:  # copies within a task needn't be sent again
                    seen.add(key)
                mark, start, run, tie = runs_of(data, length, gram)
                r = np.zeros(len(mark), RUN)
                r["mark"], r["key"], r["start"], r["run"], r["tie"] = mark, key, start, run, tie
                held.append(r)
                n += len(r)
                if n > 300_000:
                    r = np.concatenate(held)
                    yield from _deal(r, _part(r["mark"], parts))
                    held, n = [], 0
        if held:
            r = np.concatenate(held)
            yield from _deal(r, _part(r["mark"], parts))

    return run


def _records(t: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("data").to_pylist()), kind)


def _keep_repeated(parts: int):
    def run(t: pa.Table) -> pa.Table:
        r = _records(t, RUN)
        r = r[np.lexsort((r["start"], r["key"], r["mark"]))]
        new = np.ones(len(r), bool)
        new[1:] = (r["mark"][1:] != r["mark"][:-1]) | (r["key"][1:] != r["key"][:-1]) | (r["start"][1:] != r["start"][:-1])
        r = r[new]
        first = np.ones(len(r), bool)
        first[1:] = r["mark"][1:] != r["mark"][:-1]
        group = np.cumsum(first) - 1
        r = r[(np.bincount(group)[group] > 1) | (r["tie"] > 0)]
        return pa.Table.from_batches(_deal(r, _part(r["key"], parts)), schema=_PACKED)

    return run


def _by_text(kind: np.dtype):
    """Packed records -> one row per text."""
    schema = pa.schema([("key", pa.int64()), ("data", pa.binary())])

    def run(t: pa.Table) -> pa.Table:
        r = _records(t, kind)
        r = r[np.argsort(r["key"], kind="stable")]
        cuts = np.flatnonzero(r["key"][1:] != r["key"][:-1]) + 1
        bounds = np.concatenate(([0], cuts, [len(r)])) if len(r) else np.zeros(1, int)
        return pa.table([pa.array(r["key"][bounds[:-1]].copy()), pa.array([r[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], schema=schema)

    return run


def _cut_runs(length: int, parts: int):
    """Texts with their runs -> contents by shard: a count, the records, then the bytes."""

    def flush(held: list[np.ndarray], bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
        r = np.concatenate(held)
        part = _part(r["mark"], parts)
        order = np.argsort(part, kind="stable")
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(part[order])) + 1, [len(part)]))
        blobs = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            chosen = order[a:b]
            blobs.append(len(chosen).to_bytes(4, "little") + r[chosen].tobytes() + b"".join(bodies[i] for i in chosen.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(part[order][bounds[:-1]]), pa.array(blobs, pa.binary())], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bodies, size = [], [], 0
        for batch in batches:
            for text, data in zip(batch.column(0), batch.column(1), strict=True):
                body = (text.as_py() or "").encode("utf-8", "surrogatepass")
                r = np.frombuffer(data.as_py(), RUN).copy()
                r["size"] = r["run"] + (length - 1)
                held.append(r)
                bodies += [body[s : s + n] for s, n in zip(r["start"].tolist(), r["size"].tolist(), strict=True)]
                size += int(r["size"].sum())
                if size > CUT_BYTES:
                    yield from flush(held, bodies)
                    held, bodies, size = [], [], 0
        if held:
            yield from flush(held, bodies)

    return run


def _sort_shard(length: int, parts: int, memory: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = Scratch(folder, memory)
        records: list[np.ndarray] = []
        index: dict[bytes, int] = {}
        content: list[int] = []
        sizes: list[int] = []

        def distinct() -> Iterator[bytes]:
            """Equal contents are held once, known by a 128-bit hash, each followed by a byte that no string may hold."""
            for batch in batches:
                for blob in batch.column(batch.schema.get_field_index("data")):
                    blob = blob.as_py()
                    n = int.from_bytes(blob[:4], "little")
                    at = 4 + n * RUN.itemsize
                    r = np.frombuffer(blob[4:at], RUN)
                    records.append(r)
                    for size in r["size"].tolist():
                        body = blob[at : at + size]
                        at += size
                        i = index.setdefault(xxhash.xxh3_128_digest(body), len(index))
                        content.append(i)
                        if i == len(sizes):
                            sizes.append(size)
                            yield body + b"\0"

        try:
            text = scratch.gather(distinct())
            if records:
                yield from spans(scratch, text, np.concatenate(records), np.array(content), np.array(sizes))
        finally:
            scratch.close()

    def spans(scratch: Scratch, text: np.ndarray, r: np.ndarray, where: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        base = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        times = np.bincount(where, minlength=len(size))
        some = np.zeros(len(size), np.int64)
        some[where] = np.arange(len(where))
        mark, tie = r["mark"][some], r["tie"][some] > 0
        # Sorting decides for contents that stand once and share their mark, or that may repeat themselves.
        _, kind = np.unique(mark, return_inverse=True)
        shared = (np.bincount(kind)[kind] > 1) & (np.bincount(kind, weights=times == 1)[kind] > 0)
        wanted = np.flatnonzero((tie & (times == 1)) | shared)
        hit: dict[int, np.ndarray] = {}
        if len(wanted):
            if len(wanted) < len(size):
                text = scratch.gather(text[a : a + n + 1].tobytes() for a, n in zip(base[wanted].tolist(), size[wanted].tolist(), strict=True))
            own = np.concatenate(([0], np.cumsum(size[wanted] + 1)[:-1]))
            windows = size[wanted] - (length - 1)
            first = np.repeat(own - np.concatenate(([0], np.cumsum(windows)[:-1])), windows)
            found = repeated_starts(text, first + np.arange(len(first)), length, own + size[wanted], memory, folder)
            hit = dict(zip(wanted.tolist(), np.split(found, np.cumsum(windows)[:-1]), strict=True))
        out = []
        for i, key, start, n in zip(where.tolist(), r["key"].tolist(), r["start"].tolist(), r["run"].tolist(), strict=True):
            if times[i] > 1:
                out.append((key, start, start + n + length - 1))
            elif i in hit and hit[i].any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[i].view(np.int8), [0]))))
                out += [(key, start + a, start + b + length - 1) for a, b in edge.reshape(-1, 2).tolist()]
        if out:
            done = np.array(out, SPAN)
            yield from _deal(done, _part(done["key"], parts))

    return run


def merge_spans(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans, in order."""
    out: list[list[int]] = []
    for a, b in sorted(zip(spans["from"].tolist(), spans["to"].tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join((*kept, data[at:]))


def pick(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is among the distinct ``ids``; small sets are broadcast."""
    same = rows[column].eqNullSafe(ids[column])
    return rows.join(F.broadcast(ids), same, "left_semi") if ids.count() <= BROADCAST_IDS else rows


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts ``(doc_id, key, n_bytes, sha)`` of all rows, copies ``(key, n, first)`` of each text, and spans ``(key, first, data)`` of texts with repeats."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("text"))
    rows = keyed.select("doc_id", "key", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    rows = materialize(rows, "repeats-rows")
    # One row stands for each text.
    copies = materialize(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "repeats-copies")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(16, int(total / 70 * RUN.itemsize / BUCKET_BYTES) + 1)
    marked = keyed.select("key", "text").mapInArrow(_mark_texts(length, gram, buckets), PACKED)
    repeated = marked.groupBy("part").applyInArrow(_keep_repeated(buckets), PACKED)
    runs = materialize(repeated.groupBy("part").applyInArrow(_by_text(RUN), "key long, data binary"), "repeats-runs")
    size = (runs.agg(F.sum(F.octet_length("data"))).first()[0] or 0) / RUN.itemsize * (length + 70)
    shards = max(16, int(size / SHARD_BYTES) + 1)
    runs_by_text = runs
    runs = runs_with_ids = materialize(runs.join(copies.select("key", F.col("first").alias("doc_id")), "key"), "repeats-runs-ids")
    texts = pick(keyed.select("doc_id", "key", "text"), runs.select("doc_id").distinct(), "doc_id")
    runs = runs.withColumnsRenamed({"key": "run_key", "doc_id": "run_doc"})
    cut = texts.join(runs, (F.col("key") == F.col("run_key")) & F.col("doc_id").eqNullSafe(F.col("run_doc")))
    dealt = cut.select("text", "data").mapInArrow(_cut_runs(length, shards), PACKED)
    spans = dealt.groupBy("part").applyInArrow(_sort_shard(length, buckets, MEMORY, f"{shared_dir(docs.sparkSession)}/litforge/sort"), PACKED)
    spans = materialize(spans.groupBy("part").applyInArrow(_by_text(SPAN), "key long, data binary"), "repeats-spans")
    release(runs_by_text, runs_with_ids)
    return rows, copies, spans.join(copies.select("key", "first"), "key")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, copies, spans = find_repeats(docs)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, data, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                found = merge_spans(np.frombuffer(data.as_py(), SPAN))
                kept = cut_bytes((text.as_py() or "").encode("utf-8", "surrogatepass"), found)
                out.append((key, sum(b - a for a, b in found), len(found), hashlib.sha256(kept).hexdigest()))
            names = ("key", "removed", "spans", "kept")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 3 else pa.int64()) for i in range(4)], names=list(names))

    spans = materialize(spans, "repeats-spans-ids")
    texts = pick(docs.select(F.col("doc_id").alias("first"), F.coalesce("text", F.lit("")).alias("text")), spans.select("first").distinct(), "first")
    texts = texts.withColumn("key", F.xxhash64("text"))
    texts = texts.withColumnsRenamed({"first": "text_first", "key": "text_key"})
    cut = spans.join(texts, (F.col("key") == F.col("text_key")) & F.col("first").eqNullSafe(F.col("text_first"))).select("key", "data", "text").mapInArrow(measure, "key long, removed long, spans long, kept string")
    cut = cut.dropDuplicates(["key"])
    facts = copies.select("key", (F.col("n") > 1).alias("copied")).join(cut, "key", "left")
    facts = materialize(facts, "repeats-facts")
    out = with_facts(rows, facts, hot_keys(copies, "key"), "key")
    gone = F.col("copied") & (F.col("n_bytes") >= LENGTH)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, EMPTY).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with their texts cut and all other columns kept.

    A code point that loses some of its bytes is dropped.  ``n_chars`` follows the
    text where it is a column.
    """
    _, copies, spans = find_repeats(docs, length)
    facts = copies.select("key", (F.col("n") > 1).alias("copied")).join(spans.select("key", F.col("data").alias("spans")), "key", "left").filter("copied OR spans IS NOT NULL")
    facts = materialize(facts, "repeats-facts")
    columns = docs.columns
    keyed = docs.select(F.struct(*columns).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    joined = with_facts(keyed, facts, hot_keys(copies, "key"), "key").select("row.*", F.col("copied").alias("__copied"), F.col("spans").alias("__spans"))
    at, counts = columns.index("text"), "n_chars" in columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, copied, data in zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist(), b.column(len(columns) + 1).to_pylist(), strict=True):
                if text and (copied or data):
                    body = text.encode("utf-8", "surrogatepass")
                    if copied and len(body) >= length:
                        text = ""
                    elif data:
                        text = cut_bytes(body, merge_spans(np.frombuffer(data, SPAN))).decode("utf-8", "ignore")
                texts.append(text)
            out = [b.column(i) for i in range(len(columns))]
            out[at] = pa.array(texts, out[at].type)
            if counts:
                i = columns.index("n_chars")
                out[i] = pa.array([None if t is None else len(t) for t in texts], out[i].type)
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return joined.mapInArrow(run, schema)


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
