"""External induced sorting of the suffixes of a shard, with common prefixes.

The suffixes that begin at local minima (an S-type character after an L-type
one) are named in order of the strings up to the next one; the string of their names is sorted by the
same procedure, level by level, until all names differ; and their order induces
that of all others in two sweeps: L-type suffixes in ascending, then S-type ones
in descending order of their first character.

A sweep is driven by a monotone priority queue of tuples (position, common
prefix), keyed by first character; equal keys leave in the order in which they
came.  A tuple's common prefix is that with the tuple before it in its bucket: one
more than the least of those met between the two suffixes that sent them, which
a running least for each bucket keeps.  The common prefixes of the minima come
from the level below: whole names in common are their lengths, and only the first
names that differ are compared by character.

Names of more than ALPHABET kinds are written as two digits, so the number of
buckets stays small on every level; the last levels are sorted directly.

Tuples enter and leave in bulk, as arrays.  Beyond its memory a queue moves its
largest buckets to files of the scratch folder, and buckets are read back in
pieces.  The text, its types, the queues and both sweeps' results so need not
fit in memory; arrays over the local minima, about a third as many, do.

Common prefixes are exact below ``cap``, and ``cap`` stands for any longer one;
suffixes that agree for longer may stand in either order.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

#: More names than these are written as two digits each; strings of names up to DIRECT long are sorted directly.
ALPHABET = 256
DIRECT = 300_000
#: A tuple is an integer: the position above, the common prefix in the lowest bits.
BITS = 16
LCP = np.int64((1 << BITS) - 1)


class Scratch:
    """Arrays in files of a folder, removed when done.  Without a folder nothing leaves memory."""

    def __init__(self, folder: str | None, memory: int):
        self.memory = memory if folder else 1 << 62
        self.files, self.base, self.local, self.made, self.spilled = None, "", False, 0, 0
        if folder:
            self.files, base = fs.FileSystem.from_uri(folder)
            self.base, self.local = f"{base}/sort-{uuid.uuid4().hex}", isinstance(self.files, fs.LocalFileSystem)

    def put(self, data: np.ndarray) -> str:
        if not self.made:
            self.files.create_dir(self.base, recursive=True)
        self.made += 1
        self.spilled += data.nbytes
        path = f"{self.base}/{self.made}"
        with self.files.open_output_stream(path) as f:
            f.write(np.ascontiguousarray(data).view(np.uint8).data)
        return path

    def get(self, path: str, kind: np.dtype) -> np.ndarray:
        with self.files.open_input_stream(path) as f:
            data = np.frombuffer(f.read(), kind)
        self.files.delete_file(path)
        return data

    def keep(self, data: np.ndarray) -> np.ndarray:
        """The array itself, or mapped from a file where it is large."""
        if not self.local or data.nbytes * 4 < self.memory or not len(data):
            return data
        return np.memmap(self.put(data), data.dtype, "r", shape=data.shape)

    def gather(self, pieces: Iterator[bytes]) -> np.ndarray:
        """Bytes that come piece by piece, mapped from a file where they are many."""
        held, size = [], 0
        for piece in pieces:
            held.append(piece)
            size += len(piece)
            if self.local and size * 4 > self.memory:
                break
        else:
            return np.frombuffer(b"".join(held), np.uint8)
        self.files.create_dir(self.base, recursive=True)
        self.made += 1
        path = f"{self.base}/{self.made}"
        with self.files.open_output_stream(path) as f:
            for piece in (*held, *pieces):
                f.write(piece)
        return np.memmap(path, np.uint8, "r")

    def close(self) -> None:
        if self.files and self.made:
            with contextlib.suppress(OSError):
                self.files.delete_dir(self.base)


class BulkQueue:
    """Tuples by key, in order of arrival; beyond the memory the largest buckets go to disk."""

    def __init__(self, size: int, scratch: Scratch):
        self.pieces: list[list] = [[] for _ in range(size)]  # arrays, or (path, kind) of a file
        self.bytes = np.zeros(size, np.int64)
        self.scratch, self.total = scratch, 0
        self.most = scratch.memory // 4

    def push(self, key: int, values: np.ndarray) -> None:
        if len(values):
            self.pieces[key].append(values)
            self.bytes[key] += values.nbytes
            self.total += values.nbytes
            while self.total > self.most and self.bytes.any():
                self._spill(int(self.bytes.argmax()))

    def _spill(self, key: int) -> None:
        held = [p for p in self.pieces[key] if isinstance(p, np.ndarray)]
        files = [p for p in self.pieces[key] if not isinstance(p, np.ndarray)]
        data = np.concatenate(held)
        step = max(1, self.most // 8 // data.itemsize)
        # Files of a bucket are always older than what it holds in memory.
        self.pieces[key] = files + [(self.scratch.put(data[a : a + step]), data.dtype) for a in range(0, len(data), step)]
        self.total -= int(self.bytes[key])
        self.bytes[key] = 0

    def take(self, key: int) -> np.ndarray | None:
        """The oldest tuples of a bucket, in pieces; what is pushed meanwhile comes later."""
        pieces = self.pieces[key]
        if not pieces:
            return None
        if not isinstance(pieces[0], np.ndarray):
            path, kind = pieces.pop(0)
            return self.scratch.get(path, kind)
        held = [p for p in pieces if isinstance(p, np.ndarray)]
        self.pieces[key] = []
        self.total -= int(self.bytes[key])
        self.bytes[key] = 0
        return held[0] if len(held) == 1 else np.concatenate(held)

    def take_last(self, key: int) -> np.ndarray | None:
        """The youngest tuples of a bucket, itself in order of arrival."""
        if not self.pieces[key]:
            return None
        piece = self.pieces[key].pop()
        if isinstance(piece, np.ndarray):
            self.bytes[key] -= piece.nbytes
            self.total -= piece.nbytes
            return piece
        return self.scratch.get(*piece)


class GroupedQueue:
    """A queue whose buckets wait in groups and are told apart when their group's turn comes.

    So a batch is sent to a few groups instead of to each of many buckets.
    """

    def __init__(self, t: np.ndarray, size: int, scratch: Scratch):
        self.t, self.width = t, max(1, int(size**0.5))
        self.groups = -(-size // self.width)
        self.queue = BulkQueue(self.groups + size, scratch)
        self.open = -1

    def send(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Tuples sorted by key, those of a key in order of arrival."""
        places = keys.astype(np.int64) // self.width
        here = places == self.open
        places[here] = keys[here] + self.groups
        heads = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
        for place, a, b in zip(places[heads].tolist(), heads.tolist(), np.append(heads[1:], len(keys)).tolist(), strict=True):
            self.queue.push(place, values[a:b].copy())

    def take(self, key: int) -> np.ndarray | None:
        if key // self.width != self.open:
            self.open = key // self.width
            while (piece := self.queue.take(self.open)) is not None:
                keys = self.t[piece >> BITS]
                order = np.argsort(keys, kind="stable")
                self.send(keys[order], piece[order])
        return self.queue.take(self.groups + key)


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type: smaller than its successor."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    rises = t[change] < t[change + 1]
    # Equal neighbours have the type of the next change; the closing sentinel is S-type.
    out = np.ones(n, bool)
    out[:-1] = np.repeat(rises, np.diff(np.concatenate(([-1], change))))
    return out


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to cap."""
    out = np.zeros(len(a), np.int64)
    live, n = np.flatnonzero(a != b), len(t)
    out[a == b] = cap
    for _ in range(cap):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = (x < n) & (y < n)
        ok[ok] = t[x[ok]] == t[y[ok]]
        live = live[ok]
        if not len(live):
            break
        out[live] += 1
    return np.minimum(out, cap)


class _Sweep:
    """Sends on the tuples of one direction, with common prefixes."""

    def __init__(self, t: np.ndarray, small: np.ndarray, size: int, cap: int, scratch: Scratch, wanted: bool):
        self.t, self.small, self.cap, self.wanted = t, small, cap, wanted
        self.queue = GroupedQueue(t, size, scratch)
        self.least = np.full(size, cap, np.int32)
        self.last = -1
        self.fresh = True

    def open(self) -> None:
        """A bucket begins: its first suffix has nothing in common with the one before."""
        self.fresh = True

    def meet(self, batch: np.ndarray, edge: bool = False) -> None:
        """Set the first common prefix of a batch; ``edge``: its tuples come from elsewhere than those before."""
        if self.fresh or edge:
            at = int(batch[0]) >> BITS
            batch[0] = (at << BITS) | (0 if self.fresh else self._pair(self.last, at))
        self.fresh, self.last = False, int(batch[-1]) >> BITS

    def _pair(self, a: int, b: int) -> int:
        """Common prefix of two suffixes."""
        n = min(self.cap, len(self.t) - max(a, b))
        differ = np.flatnonzero(self.t[a : a + n] != self.t[b : b + n])
        return int(differ[0]) if len(differ) else n

    def send(self, batch: np.ndarray) -> None:
        """Push the suffixes before those of the batch that are of the wanted type."""
        at, lcp = batch >> BITS, batch & LCP
        chosen = np.flatnonzero(at > 0)
        before = at[chosen] - 1
        right = self.small[before] == self.wanted
        chosen, before = chosen[right], before[right]
        lows = lcp.astype(np.int32)
        if not len(before):
            np.minimum(self.least, int(lows.min()), out=self.least)
            return
        keys = self.t[before]
        order = np.argsort(keys, kind="stable")
        places, before, keys = chosen[order], before[order], keys[order]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        tails = np.append(heads[1:], len(keys)) - 1
        kinds = keys[heads]
        # The least from after the one before in the bucket to this one; the first of a bucket goes back to the batch's start.
        spans = np.empty(2 * len(places), np.int64)
        spans[1::2] = places + 1
        spans[2::2] = places[:-1] + 1
        spans[2 * heads] = 0
        padded = np.append(lows, np.int32(self.cap))
        found = np.minimum.reduceat(padded, spans)[::2]
        found[heads] = np.minimum(found[heads], self.least[kinds])
        out = (before << BITS) | np.minimum(found + 1, self.cap)
        later = np.minimum.accumulate(padded[::-1])[::-1]
        np.minimum(self.least, later[0], out=self.least)
        self.least[kinds] = later[places[tails] + 1]
        self.queue.send(keys, out)


def _induce(t: np.ndarray, small: np.ndarray, minima: np.ndarray, common: np.ndarray, size: int, cap: int, scratch: Scratch) -> BulkQueue:
    """All suffixes from the ordered local minima: buckets of tuples in descending order.

    ``common``: of each minimum with the one before.
    """
    up = _Sweep(t, small, size, cap, scratch, False)
    large = BulkQueue(size, scratch)
    first = t[minima]
    bounds = np.searchsorted(first, np.arange(size + 1))
    for c in range(size):
        up.open()
        while (batch := up.queue.take(c)) is not None:
            batch = batch.copy() if not batch.flags.writeable else batch
            up.meet(batch)
            large.push(c, batch)
            up.send(batch)
        a, b = int(bounds[c]), int(bounds[c + 1])
        if a < b:
            batch = (minima[a:b] << BITS) | common[a:b]
            up.meet(batch, edge=True)
            up.send(batch)
    down = _Sweep(t, small, size, cap, scratch, True)
    out = BulkQueue(size, scratch)
    end = np.array([(len(t) - 1) << BITS], np.int64)
    for c in range(size - 1, -1, -1):
        down.open()
        if c == 0:  # the sentinel comes from nowhere
            down.queue.send(np.zeros(1, np.int64), end)
        while (batch := down.queue.take(c)) is not None:
            batch = batch.copy() if not batch.flags.writeable else batch
            down.meet(batch)
            out.push(c, batch)
            down.send(batch)
        after = None  # common prefix of the piece's last suffix with the next larger one, already met
        while (piece := large.take_last(c)) is not None:
            # Downwards, a suffix's common prefix is the one that the next larger had with it.
            batch = (piece[::-1] >> BITS) << BITS
            batch[1:] |= piece[:0:-1] & LCP
            if after is not None:
                batch[0] |= after
            down.meet(batch, edge=after is None)
            after = int(piece[0] & LCP)
            out.push(c, batch)
            down.send(batch)
    return out


def _ranks(t: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many of the strings of ``t`` are smaller than each of them, equal ones alike.

    Sorted by several characters at a time; only those that are still alike go on.
    One that begins with all of another is the smaller: beyond its end a string
    is larger than any character.
    """
    n, m = len(t), len(starts)
    beyond = int(t.max()) + 1
    bits = beyond.bit_length()
    step = 62 // bits
    rank = np.zeros(m, np.int64)  # how many are smaller
    live, at = np.arange(m), 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for j in range(at, at + step):
            symbol = t[np.minimum(starts[live] + j, n - 1)].astype(np.int64)
            key = (key << bits) | np.where(j < length[live], symbol, beyond)
        order = np.argsort(key, kind="stable") if at == 0 else np.lexsort((key, rank[live]))
        live, key = live[order], key[order]
        group = rank[live]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        place = np.arange(len(live))
        start = place[new][np.cumsum(new) - 1]  # where a member's new group begins
        if at:
            old = np.concatenate(([True], group[1:] != group[:-1]))
            start = group + start - place[old][np.cumsum(old) - 1]
        rank[live] = start
        at += step
        heads = np.flatnonzero(new)
        longest = np.maximum.reduceat(length[live], heads)
        sizes = np.diff(np.append(heads, len(live)))
        live = live[np.repeat((sizes > 1) & (longest > at), sizes)]
    return rank


def _names(t: np.ndarray, minima: np.ndarray) -> np.ndarray:
    """Rank from 1 of the substring from each local minimum up to the next.

    Where one of them begins with all of another it goes on with an L-type, so it is the smaller.
    """
    length = np.append(np.diff(minima) + 1, 1)  # the last is the sentinel itself
    return np.unique(_ranks(t, minima, length), return_inverse=True)[1] + 1


def _order_of_minima(t: np.ndarray, minima: np.ndarray, names: np.ndarray, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Places of the local minima in order of their suffixes, and the names that each has in common with the one before."""
    m, kinds = len(names), int(names.max())
    if kinds == m:
        order = np.empty(m, np.int64)
        order[names - 1] = np.arange(m)
        return order, np.zeros(m, np.int64)
    # The last name is the sentinel's, the smallest and only one of its kind.
    digits = 2 if kinds > ALPHABET and 2 * m < 0.9 * len(t) else 1
    if digits == 2:
        base = int(np.ceil(np.sqrt(kinds + 1)))
        text = np.zeros(2 * (m - 1) + 1, np.uint16 if base < 65_000 else np.uint32)
        text[0:-1:2], text[1::2] = names[:-1] // base + 1, names[:-1] % base + 1
    else:
        text = names.astype(np.uint16 if kinds < 65_000 else np.uint32)
        text[-1] = 0
    # Two minima are two characters apart at least.
    most = digits * (cap // 2 + 2)
    order, common = suffix_sort(text, most, scratch)
    if digits == 2:
        aligned = np.flatnonzero((order % 2 == 0))
        common = np.minimum.reduceat(common, np.concatenate(([0], aligned[:-1] + 1)))
        order = order[aligned] // 2
    return order, common // digits


def _levels(t: np.ndarray, cap: int, scratch: Scratch) -> BulkQueue:
    """Buckets of all suffixes in descending order, with common prefixes."""
    n, size = len(t), int(t.max()) + 1
    t = scratch.keep(t)
    small = scratch.keep(_types(t))
    minima = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    common = np.zeros(len(minima), np.int64)
    if len(minima) > 1:
        names = _names(t, minima)
        order, whole = _order_of_minima(t, minima, names, cap, scratch)
        del names
        # Characters of the names in common, then those of the first names that differ.
        before = np.concatenate((order[:1], order[:-1]))
        reach = np.minimum(whole, len(minima) - 1 - np.maximum(order, before))
        passed = minima[order + reach] - minima[order]
        common = passed.copy()
        near = np.flatnonzero(passed < cap)
        near = near[near > 0]
        common[near] += _common(t, minima[before[near] + reach[near]], minima[order[near] + reach[near]], cap)
        common = np.minimum(common, cap)
        common[0] = 0
        minima = minima[order]
        del order, whole, before, reach, passed, near
    return _induce(t, small, minima, common, size, cap, scratch)


def suffix_sort(text: np.ndarray, cap: int, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the suffixes of ``text`` in order, and what each has in common with the one before.

    ``text`` holds unsigned integers; its last element must be 0 and the only 0.
    """
    if len(text) < 3:
        return np.argsort(text, kind="stable"), np.zeros(len(text), np.int64)
    if cap >= LCP:
        raise ValueError("common prefixes must be shorter")
    if len(text) <= DIRECT:
        order = np.argsort(_ranks(text, np.arange(len(text)), np.minimum(cap, len(text) - np.arange(len(text)))), kind="stable")
        return order, np.concatenate((np.zeros(1, np.int64), _common(text, order[:-1], order[1:], cap)))
    found = _levels(text, cap, scratch or Scratch(None, 0))
    pieces = []
    for c in range(len(found.pieces)):
        while (piece := found.take_last(c)) is not None:
            pieces.append(piece[::-1])
    # Going up, a suffix has in common with the one before what that one had with it going down.
    tuples = np.concatenate(pieces)
    return tuples >> BITS, np.concatenate((np.zeros(1, np.int64), tuples[:-1] & LCP))


def repeated_starts(text: bytes | np.ndarray, starts: np.ndarray, length: int, gap: np.ndarray | None = None, memory: int = 256 << 20, folder: str | None = None) -> np.ndarray:
    """Which of ``starts`` begin a string of ``length`` bytes that another of them begins too.

    ``gap`` marks bytes of ``text`` that no string may hold.  Sorted suffixes are
    read once, from the largest down: two wanted ones that follow each other are
    alike where the least common prefix between them is ``length``.
    """
    data = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    t = np.empty(len(data) + 1, np.uint16)
    t[:-1] = data
    t[:-1] += 2
    if gap is not None:
        t[:-1][gap] = 1
    t[-1] = 0
    if len(t) < 3:
        return np.zeros(len(starts), bool)
    if length >= LCP:
        raise ValueError("strings must be shorter")
    wanted, found = np.zeros(len(t), bool), np.zeros(len(t), bool)
    wanted[starts] = True
    scratch = Scratch(folder, memory)
    try:
        sorted_ = _levels(t, length, scratch)
        last, least = -1, length
        for c in range(len(sorted_.pieces) - 1, -1, -1):
            while (piece := sorted_.take(c)) is not None:
                at, lcp = piece >> BITS, piece & LCP
                places = np.flatnonzero(wanted[at])
                if not len(places):
                    least = min(least, int(lcp.min()))
                    continue
                between = np.minimum.reduceat(lcp[: int(places[-1]) + 1], np.concatenate(([0], places[:-1] + 1)))
                between[0] = min(int(between[0]), least)
                alike = between >= length
                hit = at[places]
                found[hit[alike]] = True
                found[hit[:-1][alike[1:]]] = True
                if alike[0] and last >= 0:
                    found[last] = True
                elif alike[0]:
                    found[hit[0]] = len(alike) > 1 and bool(alike[1])
                last, rest = int(hit[-1]), lcp[int(places[-1]) + 1 :]
                least = int(rest.min()) if len(rest) else length
    finally:
        scratch.close()
    return found[starts]
