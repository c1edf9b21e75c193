"""Near-duplicate groups by a Jaccard join over word shingles, with signature trees.

Two texts link when the Jaccard similarity of their sets of WORDS-word shingles
is PERCENT per cent or more.  The join is exact:

1. Equal sets are one: texts are known by a 64-bit hash of their set.
2. In any fixed order of shingles, the first floor(n * (100 - PERCENT) / 100) + k
   of a set of n hold k of every set that it links with among that set's own
   first ones.  With k growing with n, a set that finds too few of its first
   shingles elsewhere has no links and leaves; the others pass over nearly half
   of the k, as two of them still meet in the rest.  Only sets whose sizes allow a
   link count as elsewhere.  The order is by frequency class, then hash: shingles
   of many texts come last, so passages that many texts share seldom bring them
   together.
3. Texts that share such a shingle meet in its list.  A signature tree over the
   list prunes: a node holds the range of its set sizes and the OR of its token
   bitmaps, and a pair of nodes is left out when the bits that both have are
   fewer than any link needs.  Each shingle has a bucket and takes the next free
   bit there, so a bitmap is kept as the height of each bucket, OR is a maximum
   and the number of common bits, a sum of minima, bounds the overlap of any two
   sets below.  Nodes whose texts are joined already are skipped too.  What
   remains of a list is a spanning forest of possible links.
4. The forests' connected components hold all links.  Sets go to their
   component's task, where a tree with finer bitmaps is searched in the same way and
   every pair that it leaves is compared shingle by shingle.  Large components
   are split into blocks.  Each block is searched by itself, together with a few
   pivots that all blocks of its component get; of a group of near copies, however
   large, this joins nearly all.  The sets that remain outside their component's
   largest group then meet each other and that group in pairs of blocks.

Cases: null, empty or blank text has no shingles and no links; fewer than WORDS
words are one shingle; repeated rows are one set; rows with a null doc_id link,
but are never the smallest id of a group; texts are read whole; an empty table
gives no rows; ``keep_one`` keeps all columns, of any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litforge.llm.bpe import Memory
from litforge.llm.joins import hot_keys, with_facts
from litforge.session import materialize, release, table

#: Production parameters.
WORDS = 5
PERCENT = 80
#: A shingle in more than this share of the texts is frequent (which only orders shingles).
FREQUENT = 0.0005
#: Share of a set's shingles, in per cent, that its first ones hold beyond the least number.
EXTRA = 5
#: Least and most buckets of a bitmap in lists; twice as many for twice the shingles from 16 a bucket on.
BUCKETS = (64, 2048)
#: Texts of one batch in which shingles are counted.
BATCH = 8000
#: Bytes of postings for a task, of sets for a task, and of sets in a block of a split component.
LIST_BYTES = 2 << 20
SET_BYTES = 12 << 20
BLOCK_BYTES = 24 << 20
#: Sets of a large component that all its blocks get.
PIVOTS = 8
BROADCAST_IDS = 1_000_000

#: A shingle's 32 bits within its part (two that have them alike only make more candidates), the class of its set's size, the set.
POSTING = np.dtype([("shingle", "<u4"), ("size", "u1"), ("key", "<i8")])
#: Sizes of a class differ by this ratio at most, but for the last class.
CLASS = 1.05
COUNT = np.dtype([("shingle", "<u8"), ("n", "<i8")])
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_HASHES = Memory(xxhash.xxh3_64_intdigest)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _FACTORS[3]
    x = (x ^ (x >> np.uint64(32))) * _FACTORS[4]
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z lowered."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x = (x * _FACTORS[5]) ^ _mixed(h[i : len(h) - n + 1 + i] + _FACTORS[i % len(_FACTORS)])
    return np.unique(_mixed(x))


def set_key(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def buckets_of(n: int) -> int:
    least, most = BUCKETS
    return min(most, least << max(0, (n - 1).bit_length() - 10))


def first_ones(n: int, percent: int = PERCENT) -> int:
    """How many of a set's shingles are looked up."""
    return n * (100 - percent) // 100 + 1 + n * EXTRA // 100


def least_shared(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many of them a set with links finds again.  The other set has percent of n shingles at least.

    Of very many shingles of a set, a few may have the same 32 bits in their part and count once.
    """
    return n * EXTRA * percent // 10000 + 1 - n // 50000


def size_class(n: int) -> int:
    return min(255, int(math.log(n) / math.log(CLASS)))


def classes_apart(percent: int = PERCENT) -> int:
    """How far apart the size classes of two sets that link may be."""
    return int(math.log(100 / percent) / math.log(CLASS)) + 1


def heights(found: np.ndarray, buckets: int) -> np.ndarray:
    """Bits taken in each bucket of a set's bitmap, at most 255; further shingles of a bucket are counted by the size alone."""
    return np.minimum(np.bincount((found >> np.uint64(20)).astype(np.int64) % buckets, minlength=buckets), 255).astype(np.uint8)


def links(overlap: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


class Forest:
    """Union-find over indexes."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class SignatureTree:
    """Sizes and bitmaps of sets, OR-combined bottom-up; searched against itself."""

    LEAF = 32

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, percent: int = PERCENT):
        self.percent = percent
        self.sizes, self.bits = sizes.astype(np.int64), bits
        self.spare = self.sizes - bits.sum(axis=1, dtype=np.int64)  # shingles beyond a bucket's bits
        # Sets of like size and like bitmap side by side keep nodes tight.
        self.order = np.lexsort((bits.argmax(axis=1), bits @ np.arange(bits.shape[1]), self.sizes))
        self.nodes: list[tuple[int, int, int, int, int, np.ndarray, int, int]] = []
        self.root = self._build(0, len(sizes)) if len(sizes) else -1

    def _build(self, a: int, b: int) -> int:
        if b - a <= self.LEAF:
            rows = self.order[a:b]
            node = (a, b, int(self.sizes[rows].min()), int(self.sizes[rows].max()), int(self.spare[rows].max()), self.bits[rows].max(axis=0), -1, -1)
        else:
            left, right = self._build(a, (a + b) // 2), self._build((a + b) // 2, b)
            x, y = self.nodes[left], self.nodes[right]
            node = (a, b, min(x[2], y[2]), max(x[3], y[3]), max(x[4], y[4]), np.maximum(x[5], y[5]), left, right)
        self.nodes.append(node)
        return len(self.nodes) - 1

    def search(self, forest: Forest, ids: np.ndarray, test) -> Iterator[tuple[int, int]]:
        """Pairs of positions that may link, that ``test`` confirms and that join two trees of the forest.

        ``ids``: a position's index in the forest.
        """
        if self.root < 0:
            return
        p, stack = self.percent, [(self.root, self.root)]
        while stack:
            m, n = stack.pop()
            a0, a1, alow, ahigh, aspare, abits, aleft, aright = self.nodes[m]
            b0, b1, blow, bhigh, bspare, bbits, bleft, bright = self.nodes[n]
            if m != n:
                # Sizes within the ratio, and enough common bits for the smallest sets.
                if 100 * ahigh < p * blow or 100 * bhigh < p * alow:
                    continue
                most = int(np.minimum(abits, bbits).sum(dtype=np.int64)) + min(aspare, bspare)
                if (100 + p) * most < p * (alow + blow):
                    continue
            if a1 - a0 > 16 or b1 - b0 > 16:
                tree = forest.find(int(ids[self.order[a0]]))
                if all(forest.find(i) == tree for i in ids[self.order[a0:a1]].tolist()) and all(forest.find(i) == tree for i in ids[self.order[b0:b1]].tolist()):
                    continue
            if aleft < 0 and bleft < 0:
                yield from self._leaves(self.order[a0:a1], self.order[b0:b1], m == n, forest, ids, test)
            elif m == n:
                stack += [(aleft, aright), (aright, aright), (aleft, aleft)]
            elif bleft < 0 or (aleft >= 0 and a1 - a0 >= b1 - b0):
                stack += [(aright, n), (aleft, n)]
            else:
                stack += [(m, bright), (m, bleft)]

    def _leaves(self, a: np.ndarray, b: np.ndarray, same: bool, forest: Forest, ids: np.ndarray, test) -> Iterator[tuple[int, int]]:
        most = np.minimum(self.bits[a][:, None], self.bits[b][None]).sum(axis=2, dtype=np.int64) + np.minimum(self.spare[a][:, None], self.spare[b][None])
        small, large = np.minimum(self.sizes[a][:, None], self.sizes[b][None]), np.maximum(self.sizes[a][:, None], self.sizes[b][None])
        ok = ((100 + self.percent) * most >= self.percent * (small + large)) & (100 * small >= self.percent * large)
        if same:
            ok = np.triu(ok, 1)
        for i, j in np.argwhere(ok).tolist():
            x, y = int(a[i]), int(b[j])
            if forest.find(int(ids[x])) != forest.find(int(ids[y])) and test(x, y):
                forest.join(int(ids[x]), int(ids[y]))
                yield x, y


def _measure(words: int, share: float):
    """A row per text, with its set's size, key and bitmap, and rows of shingles that are frequent in a batch."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("bits", pa.binary()), ("frequent", pa.binary())])

    def rows(ids, texts, sizes, keys, bits) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, texts, pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(ids), pa.binary())], schema=schema)

    def count(sets: list[np.ndarray], texts: int) -> pa.RecordBatch:
        # A shingle in more than a share of all texts is in more than that share of some batch.
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        chosen = n > max(1, int(share * texts))
        if texts < 2 / share:
            chosen = n >= 2  # too few texts for the share: all that occur twice
        packed = np.rec.fromarrays((found[chosen], n[chosen].astype("<i8")), dtype=COUNT).tobytes()
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen, held = [], set(), 0
        for batch in batches:
            out = ([], [], [])
            for text in batch.column(1):
                found = shingles(text.as_py(), words)
                key = set_key(found) if len(found) else None
                out[0].append(len(found))
                out[1].append(key)
                out[2].append(heights(found, buckets_of(len(found))).tobytes())
                if key is not None and key not in seen:
                    seen.add(key)
                    sets.append(found)
                    held += len(found)
                if len(sets) >= BATCH or held > 6_000_000:
                    yield count(sets, len(sets))
                    sets, seen, held = [], set(), 0
            yield rows(batch.column(0), batch.column(2), *out)
        if sets:
            yield count(sets, len(sets))
        _HASHES.clear()  # workers live on

    return run


def _postings(words: int, percent: int, frequent: np.ndarray, parts: int):
    schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])

    def flush(held: list[tuple[np.ndarray, int, int]]) -> Iterator[pa.RecordBatch]:
        found, times = np.concatenate([x for x, _, _ in held]), [len(x) for x, _, _ in held]
        r = np.empty(len(found), POSTING)
        r["shingle"] = (found * _FACTORS[6]) >> np.uint64(32)
        r["size"] = np.repeat(np.array([x for _, x, _ in held], np.uint8), times)
        r["key"] = np.repeat(np.array([x for _, _, x in held], np.int64), times)
        part = (found >> np.uint64(11)) % np.uint64(parts)
        order = np.argsort(part.astype(np.int32), kind="stable")
        r, part = r[order], part[order].astype(np.int32)
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
        blobs = [r[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[bounds[:-1]]), pa.array(blobs, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()
        for batch in batches:
            for text in batch.column(0):
                found = shingles(text.as_py(), words)
                if not len(found):
                    continue
                key = set_key(found)
                if key in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(key)
                if len(frequent):
                    at = np.searchsorted(frequent, found)
                    often = frequent[np.minimum(at, len(frequent) - 1)] == found
                    found = np.concatenate((found[~often], found[often]))
                held.append((found[: first_ones(len(found), percent)].copy(), size_class(len(found)), key))
                n += len(held[-1][0])
                if n > 600_000:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)
        _HASHES.clear()

    return run


def _shared(percent: int):
    """Postings of shingles that two sets of sizes that may link have, and the sets' keys with their number of these."""
    apart = classes_apart(percent)

    def run(t: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(t.column("data").to_pylist()), POSTING)
        r = r[np.lexsort((r["key"], r["size"], r["shingle"]))]
        same = r["shingle"][1:] == r["shingle"][:-1]
        r = r[np.concatenate((np.ones(min(1, len(r)), bool), ~(same & (r["key"][1:] == r["key"][:-1]))))]
        # By size within a shingle: a set's nearest in size stand beside it.
        meet = (r["shingle"][1:] == r["shingle"][:-1]) & (r["size"][1:] - r["size"][:-1] <= apart)
        kept = np.zeros(len(r), bool)
        kept[1:] |= meet
        kept[:-1] |= meet
        r = r[kept]
        part = t.column("part")[0].as_py()
        keys, times = np.unique(r["key"], return_counts=True)
        kind = pa.list_(pa.int64())
        return pa.table({"part": pa.array([part], pa.int32()), "data": pa.array([r.tobytes()], pa.binary()), "keys": pa.array([keys.tolist()], kind), "times": pa.array([times.tolist()], kind)})

    return run


def _dealt(buckets: int):
    """The keys of each list and their times, by bucket of the keys."""
    schema = pa.schema([("bucket", pa.int32()), ("list", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                keys, times = (batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in ("keys", "times"))
                order = np.argsort(keys % buckets, kind="stable")
                bucket = (keys % buckets)[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                parts = [(keys[x].astype("<i8").tobytes(), times[x].astype("<i8").tobytes()) for x in np.split(order, cuts[1:])] if len(cuts) else []
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array([batch.column("part")[at].as_py()] * len(cuts), pa.int32()), pa.array([x for x, _ in parts], pa.binary()), pa.array([x for _, x in parts], pa.binary())], schema=schema)

    return run


def _handed(percent: int):
    """Keys by list and sets of a bucket -> for each list keys, sizes and bitmaps of the sets that may have links.

    Two sets that link share least_shared of either at least, so they still meet
    if each passes over fewer than half of its own.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes, bytes, bytes]] = []
        if len(left) and len(right):
            keys, times = (np.concatenate([np.frombuffer(x, "<i8") for x in left.column(c).to_pylist()]) for c in ("keys", "times"))
            own = np.repeat(left.column("list").to_numpy(), [len(x) // 8 for x in left.column("keys").to_pylist()])
            known = right.column("key").to_numpy()
            by = np.argsort(known, kind="stable")
            at = by[np.searchsorted(known[by], keys)]
            n, bits = right.column("n").to_numpy(), right.column("bits")
            order = np.lexsort((own, times, at))
            at, own, times = at[order], own[order], times[order]
            shared = np.bincount(at, times, len(known)).astype(np.int64)
            upto = np.cumsum(times) - (np.cumsum(shared) - shared)[at]
            least = least_shared(n, percent)
            kept = (shared >= least)[at] & (upto > (least[at] - 1) // 2)
            at, own = at[kept], own[kept]
            order = np.argsort(own, kind="stable")
            at, own = at[order], own[order]
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            for x, some in zip(own[cuts].tolist(), np.split(at, cuts[1:]) if len(cuts) else [], strict=True):
                out.append((x, known[some].astype("<i8").tobytes(), n[some].astype("<i8").tobytes(), b"".join(bits.take(pa.array(some)).to_pylist())))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=["list", "keys", "n", "bits"])

    return run


def _forest(percent: int):
    """Lists and the bitmaps of their sets -> a spanning forest of possible links."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        edges: list[tuple[int, int]] = []
        if len(left) and len(right):
            keys, sizes = (np.concatenate([np.frombuffer(x, "<i8") for x in right.column(c).to_pylist()]) for c in ("keys", "n"))
            widths = np.array([buckets_of(n) for n in sizes.tolist()])
            ends, data = np.cumsum(widths).tolist(), b"".join(right.column("bits").to_pylist())
            blobs = [data[b - w : b] for b, w in zip(ends, widths.tolist(), strict=True)]
            keys, where = np.unique(keys, return_index=True)
            sizes = sizes[where]
            width = widths[where]
            # Bitmaps of one width, with those of twice the width folded to it: links join no others.
            bits, row = {}, {}
            for w in np.unique(width).tolist():
                chosen = np.flatnonzero((width == w) | (width == 2 * w))
                folded = [np.frombuffer(blobs[where[i]], np.uint8).astype(np.uint16).reshape(-1, w).sum(axis=0) for i in chosen.tolist()]
                bits[w] = np.minimum(np.stack(folded), 255).astype(np.uint8)
                row[w] = np.zeros(len(keys), np.int64)
                row[w][chosen] = np.arange(len(chosen))
            r = np.frombuffer(b"".join(left.column("data").to_pylist()), POSTING)
            index = np.minimum(np.searchsorted(keys, r["key"]), len(keys) - 1)
            known = keys[index] == r["key"]  # others have left
            r, index = r[known], index[known]
            bounds = np.concatenate(([0], np.flatnonzero(r["shingle"][1:] != r["shingle"][:-1]) + 1, [len(r)])) if len(r) else np.zeros(1, np.int64)
            length = np.diff(bounds)
            forest = Forest(len(keys))
            # Lists of two or three at once, as arrays.
            pairs = [np.empty((0, 2), np.int64)]
            for n, steps in ((2, ((0, 1),)), (3, ((0, 1), (0, 2), (1, 2)))):
                at = bounds[:-1][length == n]
                pairs += [np.stack((index[at + i], index[at + j]), axis=1) for i, j in steps]
            pair = np.unique(np.concatenate(pairs), axis=0)
            small, large = np.minimum(*sizes[pair].T), np.maximum(*sizes[pair].T)
            pair = pair[100 * small >= percent * large]
            for w, matrix in bits.items():
                own = pair[np.minimum(*width[pair].T) == w]
                for a in range(0, len(own), 20_000):
                    x, y = own[a : a + 20_000].T
                    bx, by = matrix[row[w][x]], matrix[row[w][y]]
                    spare = np.minimum(sizes[x] - bx.sum(axis=1, dtype=np.int64), sizes[y] - by.sum(axis=1, dtype=np.int64))
                    most = np.minimum(bx, by).sum(axis=1, dtype=np.int64) + spare
                    ok = (100 + percent) * most >= percent * (sizes[x] + sizes[y])
                    edges += [(i, j) for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True) if forest.join(i, j)]
            done: set[bytes] = set()
            for at in np.flatnonzero(length > 3).tolist():
                ids = index[bounds[at] : bounds[at + 1]]
                if ids.tobytes() in done:
                    continue
                done.add(ids.tobytes())
                for w in np.unique(width[ids]).tolist():
                    near = ids[(width[ids] == w) | (width[ids] == 2 * w)]
                    if len({forest.find(i) for i in near.tolist()}) > 1:
                        tree = SignatureTree(sizes[near], bits[w][row[w][near]], percent)
                        edges += [(int(near[x]), int(near[y])) for x, y in tree.search(forest, near, lambda x, y: True)]
            edges = [(int(keys[i]), int(keys[j])) for i, j in edges]
        a = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(a.min(axis=1) if len(a) else a[:, 0]), "b": pa.array(a.max(axis=1) if len(a) else a[:, 0])})

    return run


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(key, root)``: the smallest key that each key of ``edges(a, b)`` reaches.

    Alternating stars: every key hands its larger neighbours, then its smaller
    ones, to the smallest key that it knows, until all point at one.  Each round
    is written, so a lost executor costs a task of one round.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialize(edges, f"{name}-edges")
    before = None
    while True:
        # The smallest neighbour of each key, itself included.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b")
        large = materialize(large.filter("a <> b").distinct(), f"{name}-large")
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("low").alias("a"))
        older, edges = edges, materialize(small.filter("a <> b").distinct(), f"{name}-small")
        release(older, large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("b").alias("key"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("key"), F.col("a").alias("root")).distinct())


def _sets(words: int):
    """Sets of ``(text, key, root, blocks)``, of those texts whose set has that key."""
    schema = pa.schema([("key", pa.int64()), ("root", pa.int64()), ("blocks", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.slice(at, 500)
                found = [shingles(t.as_py(), words) for t in some.column(0)]
                right = [i for i, (x, key) in enumerate(zip(found, some.column(1).to_pylist(), strict=True)) if set_key(x) == key]
                facts = [some.column(i).take(pa.array(right, pa.int64())) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([*facts, pa.array([found[i].tobytes() for i in right], pa.binary())], schema=schema)
        _HASHES.clear()

    return run


def _texts_of(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(text, key, root, blocks)``: for each of ``known(key, root, blocks, first, first_text)`` the text by which it is known.

    ``known`` is broadcast, by shares where it is long, so no text is dealt out.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text", F.xxhash64("text").alias("doc_text"))
    shares = max(1, -(-known.count() // BROADCAST_IDS))
    out = None
    for i in range(shares):
        few = known.filter(F.pmod(F.xxhash64("key"), F.lit(shares)) == i)
        here = texts.join(F.broadcast(few), F.col("doc").eqNullSafe(F.col("first")) & (F.col("doc_text") == F.col("first_text"))).select("text", "key", "root", "blocks")
        out = here if out is None else out.unionByName(here)
    return out


def _exact(percent: int):
    """Sets of whole components, or of blocks of one -> a spanning forest of links.

    With a column ``label``, sets of a label are known to be linked.
    """

    def run(t: pa.Table) -> pa.Table:
        keys, roots = t.column("key").to_numpy(), t.column("root").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("data").to_pylist()]
        labels = t.column("label").to_numpy() if "label" in t.column_names else None
        edges: list[tuple[int, int]] = []
        order = np.lexsort((keys, roots))
        for rows in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            rows = rows[np.concatenate(([True], keys[rows][1:] != keys[rows][:-1]))]
            if len(rows) < 2:
                continue
            sizes = np.array([len(sets[i]) for i in rows])
            buckets = 1 << min(12, max(6, int(sizes.max()).bit_length() - 1))
            tree = SignatureTree(sizes, np.stack([heights(sets[i], buckets) for i in rows]), percent)

            def same(x: int, y: int, rows=rows) -> bool:
                a, b = sets[rows[x]], sets[rows[y]]
                at = np.searchsorted(a, b)
                return links(int((a[np.minimum(at, len(a) - 1)] == b).sum()), len(a), len(b), percent)

            forest = Forest(len(rows))
            if labels is not None:
                by = np.argsort(labels[rows], kind="stable")
                for x, y in zip(by[:-1].tolist(), by[1:].tolist(), strict=True):
                    if labels[rows[x]] == labels[rows[y]]:
                        forest.join(x, y)
            edges += [(int(keys[rows[x]]), int(keys[rows[y]])) for x, y in tree.search(forest, np.arange(len(rows)), same)]
        a = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(a[:, 0].copy()), "b": pa.array(a[:, 1].copy())})

    return run


def _exact_in_blocks(members: DataFrame, part: Column, percent: int) -> DataFrame:
    """Edges ``(a, b)`` that join all linked sets of ``members(key, root, blocks, block, data)``, whose large components are in blocks."""
    large = members.filter("blocks > 1")
    heads = large.groupBy("root", "block").agg(F.min("key").alias("key"))
    heads = heads.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy("block"))).filter(F.col("nth") <= PIVOTS)
    pivots = large.join(heads.select("key"), "key", "left_semi")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    rows = members.unionByName(pivots.select("key", "root", "blocks", every, "data"))
    edges = rows.select("key", "root", "data", part.alias("part")).groupBy("part").applyInArrow(_exact(percent), "a long, b long")
    edges = materialize(edges, "join-within")
    # What lies outside a component's largest group is compared with all of it.
    groups = components(edges, "join-within").select("key", F.col("root").alias("label"))
    placed = materialize(large.select("key", "root").join(groups, "key", "left").withColumn("label", F.coalesce("label", "key")), "join-placed")
    main = placed.groupBy("root", "label").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    sized = large.select("key", F.octet_length("data").alias("size")).join(placed, "key").join(main, "root")
    cuts = sized.withColumn("rest", F.col("label") != F.col("main")).groupBy("root", "main").agg(
        F.ceil(F.sum(F.when(F.col("rest"), F.col("size"))) / BLOCK_BYTES).cast("int").alias("cuts"), F.ceil(F.sum(F.when(~F.col("rest"), F.col("size"))) / BLOCK_BYTES).cast("int").alias("mains")
    )
    cuts = materialize(cuts.filter("cuts > 0"), "join-cuts")
    if cuts.isEmpty():
        return edges
    # Blocks of the rest meet each other and the blocks of the largest group.
    rows = large.select("key", "root", "data").join(placed.select("key", "label"), "key").join(F.broadcast(cuts) if cuts.count() <= BROADCAST_IDS else cuts, "root")
    at = lambda n: F.pmod(F.xxhash64("key", F.lit(1)), F.col(n)).cast("int")
    over = lambda n, pair: F.transform(F.sequence(F.lit(0), F.col(n) - 1), pair)
    meet = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    outside = F.concat(over("cuts", lambda j: meet(0, F.least(at("cuts"), j), F.greatest(at("cuts"), j))), over("mains", lambda j: meet(1, at("cuts"), j)))
    pairs = F.when(F.col("label") != F.col("main"), outside).otherwise(over("cuts", lambda i: meet(1, i, at("mains"))))
    pairs = rows.select("key", "root", "label", "data", F.explode(pairs).alias("pair")).select("key", "root", "label", "data", F.xxhash64("root", "pair").alias("part"))
    return edges.unionByName(pairs.groupBy("part").applyInArrow(_exact(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``, and ``text_key``, a hash of its text."""
    measured = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(_measure(words, FREQUENT), "doc_id long, text_key long, n long, key long, bits binary, frequent binary")
    measured = materialize(measured, "join-measures")
    rows = measured.filter("frequent IS NULL").select("doc_id", "text_key", "n", "key", "bits")
    facts = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("rows"))
    facts = materialize(facts.select("key", F.col("least.doc_id").alias("first"), F.col("least.text_key").alias("first_text"), "n", "bits", "rows"), "join-sets")
    total = facts.agg(F.count("*"), F.sum("n")).first()
    texts, postings = total[0], (total[1] or 0) * (100 - percent + EXTRA) / 100 + total[0]
    often = measured.filter("frequent IS NOT NULL").select(F.col("frequent").alias("data")).mapInArrow(_counts, "shingle long, n long")
    often = often.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > max(2, FREQUENT * texts))
    # At most (mean set size) / FREQUENT shingles can be in more than that share of the texts.
    frequent = np.sort(np.array([r.shingle for r in often.select("shingle").toLocalIterator()], np.int64).view(np.uint64))

    parts = max(8, int(postings * POSTING.itemsize / LIST_BYTES) + 1)
    lists = docs.select("text").mapInArrow(_postings(words, percent, frequent, parts), "part int, data binary")
    lists = materialize(lists.groupBy("part").applyInArrow(_shared(percent), "part int, data binary, keys array<long>, times array<long>"), "join-lists")
    # Sets go through as bytes, by bucket: a row for each list that a set stands in would be far more rows than sets.
    buckets = max(8, parts // 4)
    met = lists.select("part", "keys", "times").mapInArrow(_dealt(buckets), "bucket int, list int, keys binary, times binary")
    placed = facts.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key", "n", "bits")
    met = met.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(_handed(percent), "list int, keys binary, n binary, bits binary")
    edges = lists.select("part", "data").groupBy("part").cogroup(met.groupBy("list")).applyInArrow(_forest(percent), "a long, b long")
    roots = materialize(components(edges, "join-possible"), "join-possible")

    known = known_sets = materialize(roots.join(facts.select("key", "first", "first_text", "n"), "key"), "join-members")
    sizes = known.groupBy("root").agg((8 * F.sum("n")).alias("bytes"))
    sizes = sizes.withColumn("blocks", F.when(F.col("bytes") <= 2 * BLOCK_BYTES, 1).otherwise(F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int"))
    tasks = max(8, int((known.agg(F.sum("n")).first()[0] or 0) * 8 / SET_BYTES) + 1)
    known = materialize(known.join(sizes.select("root", "blocks"), "root").select("key", "root", "blocks", "first", "first_text"), "join-placing")
    members = _texts_of(docs, known).mapInArrow(_sets(words), "key long, root long, blocks int, data binary").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    part = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("root", "block"))
    if known.filter("blocks > 1").isEmpty():
        exact = members.select("key", "root", "data", part.alias("part")).groupBy("part").applyInArrow(_exact(percent), "a long, b long")
    else:
        exact = _exact_in_blocks(materialize(members, "join-blocks"), part, percent)
    groups = components(exact, "join-exact")
    release(lists, roots, known_sets, known)

    least = groups.join(facts.select("key", "first"), "key").groupBy("root").agg(F.min("first").alias("component_id"))
    labels = groups.join(least, "root").select("key", F.col("component_id").alias("linked"))
    labels = facts.select("key", "first").join(labels, "key", "left").select("key", F.coalesce("linked", "first").alias("component_id"))
    labels = materialize(labels, "join-labels")
    out = with_facts(rows.select("doc_id", "text_key", "n", "key"), labels, hot_keys(facts, "key", "rows"), "key")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_key")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        r = np.frombuffer(b"".join(batch.column(0).to_pylist()), COUNT)
        yield pa.RecordBatch.from_arrays([pa.array(r["shingle"].view(np.int64) if r["shingle"].flags.c_contiguous else r["shingle"].copy().view(np.int64)), pa.array(r["n"].copy())], names=["shingle", "n"])


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id, with its columns.

    Rows are told apart by doc_id and text: where an id stands on two texts, each
    is judged by itself, and of rows that repeat both one stays.  Rows without a
    doc_id go where their group has one; otherwise one of each text stays.
    """
    groups = near_duplicates(docs, words, percent).withColumn("doc_key", F.xxhash64("doc_id"))
    groups = materialize(groups.withColumn("first", F.expr("doc_id <=> component_id")).groupBy("doc_key", "text_key").agg(F.bool_or("first").alias("first"), F.count("*").alias("times")), "join-groups")
    gone, again = groups.filter("NOT first"), groups.filter("first AND times > 1")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col("doc_id").cast("bigint")).alias("doc_key"), F.xxhash64("text").alias("text_key"))
    small = lambda df: F.broadcast(df.select("doc_key", "text_key")) if df.count() <= BROADCAST_IDS else df.select("doc_key", "text_key")
    kept = packed.join(small(gone), ["doc_key", "text_key"], "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    once = kept.join(small(again), ["doc_key", "text_key"], "left_semi").dropDuplicates(["doc_key", "text_key"])
    return kept.join(small(again), ["doc_key", "text_key"], "left_anti").unionByName(once).select("row.*")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLE_SQL = {
    "op1_ngram_join": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
linked AS (
  SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= {PERCENT} * (s.n + t.n - c)),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reached r JOIN linked l ON l.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
""",
}
