"""External induced sorting of the suffixes of a byte string, with capped common-prefix values.

Level by level: the leftmost-S ("LMS") substrings are sorted by one induction and named; where names repeat, the reduced
string of names is sorted by doubling, up to `cap` bytes; a second induction carries suffix tuples (position,
common prefix with the tuple before) from the sorted LMS suffixes to all L suffixes and from those to all S suffixes. The
priority queues are ordered by (first byte, arrival), ascending for L and descending for S, and move their largest buckets
to disk above `memory` bytes; text, types and marks are memory-mapped files once they are large. Order among suffixes that
agree in `cap` bytes is arbitrary and their common prefix is `cap`.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np

MEMORY, CHUNK, PAIRS = 64 << 20, 1 << 18, 1 << 13
_FAR = 1 << 14  # above any common prefix


class BucketQueue:
    """First-in first-out buckets by first byte; the largest go to disk when the whole outgrows `memory`."""

    def __init__(self, folder: str, name: str, memory: int):
        self.folder, self.name, self.memory, self.held = folder, name, memory, 0
        self.parts: list[list[np.ndarray]] = [[] for _ in range(256)]
        self.bytes, self.spilled, self.read_at = [0] * 256, [0] * 256, [0] * 256

    def _file(self, c: int) -> Path:
        return Path(self.folder, f"{self.name}-{c}")

    def push(self, c: int, tuples: np.ndarray) -> None:
        self.parts[c].append(tuples)
        self.bytes[c] += tuples.nbytes
        self.held += tuples.nbytes
        while self.held > self.memory:
            self._spill(max(range(256), key=self.bytes.__getitem__))

    def _spill(self, c: int) -> None:
        with self._file(c).open("ab") as out:
            for part in self.parts[c]:
                part.tofile(out)
                self.spilled[c] += len(part)
        self.held -= self.bytes[c]
        self.parts[c], self.bytes[c] = [], 0

    def chunks(self, c: int) -> Iterator[np.ndarray]:
        """All tuples of the bucket in order of arrival, those that arrive meanwhile included; they leave the queue."""
        while True:
            if self.read_at[c] < self.spilled[c]:
                part = np.fromfile(self._file(c), TUPLE, min(CHUNK, self.spilled[c] - self.read_at[c]), offset=self.read_at[c] * TUPLE.itemsize)
                self.read_at[c] += len(part)
            elif self.parts[c]:
                part = np.concatenate(self.parts[c]) if len(self.parts[c]) > 1 else self.parts[c][0]
                self.held -= self.bytes[c]
                self.parts[c], self.bytes[c] = [], 0
            else:
                return
            for k in range(0, len(part), CHUNK):
                yield part[k : k + CHUNK]


TUPLE = np.dtype([("at", "<i8"), ("common", "<i2")])


def _tuples(at: np.ndarray, common: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), TUPLE)
    out["at"], out["common"] = at, common
    return out


def _array(n: int, kind: type, folder: str, name: str, memory: int) -> np.ndarray:
    return np.memmap(Path(folder, name), kind, "w+", shape=(n,)) if n * np.dtype(kind).itemsize > memory else np.empty(n, kind)


class InducedSorter:
    def __init__(self, text: np.ndarray, cap: int, folder: str, memory: int = MEMORY):
        self.n, self.cap, self.folder, self.memory = len(text), cap, folder, memory
        self.padded = _array(self.n + cap + 16, np.uint8, folder, "text", memory)
        self.padded[: self.n], self.padded[self.n :] = text, 0
        self.text = self.padded[: self.n]
        width = -(-cap // 8) * 8
        self.windows = np.ndarray((self.n + 1,), np.dtype((np.void, width)), buffer=self.padded, strides=(1,))
        self.small = _array(self.n, bool, folder, "types", memory)  # S type: less than the next suffix
        step = np.sign(np.diff(self.text.astype(np.int16), append=-1))
        differs = np.where(step != 0, np.arange(self.n), self.n)
        following = np.minimum.accumulate(differs[::-1])[::-1]
        self.small[:] = step[following] > 0
        lms = self.small.copy()
        lms[1:] &= ~self.small[:-1]
        lms[0] = False
        self.lms = np.flatnonzero(lms)
        self.is_lms = lms
        self.runs = 0

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes, up to cap: both are copied out whole, a few thousand pairs at a time."""
        out = np.empty(len(p), np.int64)
        for k in range(0, len(p), PAIRS):
            x, y = (self.windows[at[k : k + PAIRS]].view("<u8").reshape(-1, self.windows.itemsize // 8) for at in (p, q))
            differs = x != y
            word = differs.argmax(1)
            rows = np.arange(len(word))
            low = x[rows, word] ^ y[rows, word]
            same = sum(((low & np.uint64((1 << (8 * j)) - 1)) == 0).astype(np.int64) for j in range(1, 8))
            out[k : k + PAIRS] = np.where(differs[rows, word], np.minimum(8 * word + same, self.cap), self.cap)
        return out

    def _send(self, queue: BucketQueue, chunk: np.ndarray, small: bool, since: np.ndarray | None) -> None:
        """Pushes the predecessors of the asked type; since: per byte, the least common value since its last push."""
        at = chunk["at"] - 1
        ok = at >= 0
        ok[ok] = self.small[at[ok]] == small
        rows = np.flatnonzero(ok)
        common = chunk["common"]
        if since is None:
            lead = self.text[at[rows]]
            order = np.argsort(lead, kind="stable")
            lead, at = lead[order], at[rows[order]]
            for k in np.split(np.arange(len(lead)), np.flatnonzero(np.diff(lead)) + 1) if len(lead) else ():
                queue.push(int(lead[k[0]]), _tuples(at[k], np.zeros(len(k), np.int16)))
            return
        lead = self.text[at[rows]]
        order = np.argsort(lead, kind="stable")
        lead, rows = lead[order], rows[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(lead)) + 1, [len(lead)]]) if len(lead) else np.zeros(1, np.int64)
        sent = np.zeros(256, bool)
        for a, b in zip(edges, edges[1:]):
            c, own = int(lead[a]), rows[a:b]
            sent[c] = True
            least = np.minimum.reduceat(common, np.concatenate([[0], own[:-1] + 1]))
            # reduceat runs to the next start; the last stretch must end at its own row.
            least[-1] = common[(own[-2] + 1 if len(own) > 1 else 0) : own[-1] + 1].min()
            least[0] = min(least[0], since[c])
            queue.push(c, _tuples(at[own], np.minimum(least + 1, self.cap)))
            since[c] = common[own[-1] + 1 :].min() if own[-1] + 1 < len(common) else _FAR
        since[~sent] = np.minimum(since[~sent], common.min())

    def induce(self, sorted_lms: np.ndarray, common: np.ndarray | None) -> Iterator[tuple[str, int, np.ndarray]]:
        """('L' ascending, byte, tuples) of all L suffixes and then ('S' descending, byte, tuples) of all S suffixes."""
        self.runs += 1
        large, small = BucketQueue(self.folder, f"L{self.runs}", self.memory), BucketQueue(self.folder, f"S{self.runs}", self.memory)
        done = BucketQueue(self.folder, f"D{self.runs}", self.memory)
        with_common = common is not None
        values = common if with_common else np.zeros(len(sorted_lms), np.int64)
        lead = self.text[sorted_lms]
        bounds = np.searchsorted(lead, np.arange(257))
        # -1 for a byte that nothing has reached yet: its first tuple then gets the common prefix 0.
        since = np.full(256, -1, np.int64) if with_common else None
        last = {}
        self._send(large, _tuples(np.array([self.n]), np.array([0])), False, since)
        for c in range(256):
            for chunk in large.chunks(c):
                last[c] = int(chunk["at"][-1])
                done.push(c, chunk)
                yield "L", c, chunk
                self._send(large, chunk, False, since)
            own = slice(bounds[c], bounds[c + 1])
            if own.start < own.stop:
                stars = _tuples(sorted_lms[own], values[own])
                if with_common:
                    stars["common"][0] = self.common(np.array([last[c]]), stars["at"][:1])[0] if c in last else 0
                for k in range(0, len(stars), CHUNK):
                    self._send(large, stars[k : k + CHUNK], False, since)
        since = np.full(256, -1, np.int64) if with_common else None
        for c in range(255, -1, -1):
            tail = None
            for chunk in small.chunks(c):
                tail = int(chunk["at"][-1])
                yield "S", c, chunk
                self._send(small, chunk, True, since)
            whole = np.concatenate(list(done.chunks(c)) or [np.empty(0, TUPLE)])
            if len(whole):
                back = whole[::-1].copy()
                back["common"][1:] = whole["common"][:0:-1]
                back["common"][0] = self.common(np.array([tail]), back["at"][:1])[0] if with_common and tail is not None else 0
                for k in range(0, len(back), CHUNK):
                    self._send(small, back[k : k + CHUNK], True, since)

    def sorted_lms(self) -> np.ndarray:
        """LMS suffixes in order, up to cap bytes."""
        if len(self.lms) < 2:
            return self.lms
        first = self.lms[np.argsort(self.text[self.lms], kind="stable")]
        parts = [chunk["at"][self.is_lms[chunk["at"]]] for kind, _, chunk in self.induce(first, None) if kind == "S"]
        order = np.concatenate(parts)[::-1]
        stop = np.append(self.lms[1:], self.n - 1)  # each substring runs to the next LMS position, included
        index = np.searchsorted(self.lms, order)
        length = np.minimum(stop[index] - order + 1, self.cap)
        new = np.ones(len(order), bool)
        new[1:] = (length[1:] != length[:-1]) | (self.common(order[1:], order[:-1]) < length[1:])
        # A rank is the place of its group's first suffix, so that only groups of two or more are sorted again.
        rank = np.empty(len(order), np.int64)
        rank[index] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        reach = 1
        live = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)
        while len(live) and reach * 2 < self.cap + 2:
            ahead = np.where(live + reach < len(rank), rank[np.minimum(live + reach, len(rank) - 1)], -1)
            pair = rank[live] * (len(rank) + 1) + ahead + 1
            by = np.argsort(pair, kind="stable")
            old, pair = rank[live[by]], pair[by]
            place = np.arange(len(by))
            group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
            part = np.maximum.accumulate(np.where(np.append(True, pair[1:] != pair[:-1]), place, 0))
            rank[live[by]] = old + part - group
            live = live[np.bincount(rank, minlength=len(rank))[rank[live]] > 1]
            reach *= 2
        return self.lms[np.argsort(rank, kind="stable")]

    def repeated(self) -> np.ndarray:
        """Mark of every position whose suffix agrees with another one in cap bytes."""
        marks = _array(self.n, bool, self.folder, "marks", self.memory)
        marks[:] = False
        stars = self.sorted_lms()
        shared = np.concatenate([[0], self.common(stars[1:], stars[:-1])]) if len(stars) else np.zeros(0, np.int64)
        before: dict[tuple[str, int], int] = {}
        edge: dict[int, int] = {}
        for kind, c, chunk in self.induce(stars, shared):
            at, common = chunk["at"], chunk["common"]
            equal = np.flatnonzero(common >= self.cap)
            marks[at[equal]] = True
            marks[at[equal[equal > 0] - 1]] = True
            if len(equal) and equal[0] == 0 and (kind, c) in before:
                marks[before[kind, c]] = True
            before[kind, c] = int(at[-1])
            if kind == "L":
                edge[c] = int(at[-1])
        # The last L suffix and the first S suffix of a byte stand side by side.
        pairs = [(edge[c], before["S", c]) for c in range(256) if c in edge and ("S", c) in before]
        if pairs:
            a, b = np.array(pairs).T
            equal = self.common(a, b) >= self.cap
            marks[a[equal]] = marks[b[equal]] = True
        return marks


def repeated_positions(text: np.ndarray, cap: int, memory: int = MEMORY) -> np.ndarray:
    """Positions (marks) whose next `cap` bytes also start elsewhere in the text; the text may be larger than memory."""
    if not len(text):
        return np.zeros(0, bool)
    with tempfile.TemporaryDirectory(prefix="induced-") as folder:
        return np.array(InducedSorter(text, cap, folder, memory).repeated())
