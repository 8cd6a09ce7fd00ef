"""External induced sorting of suffixes, with common-prefix values.

Symbols are classified as rising (S) or falling (L). The suffixes at LMS places
(an S after an L) are put in order first: their substrings are sorted by one
induction, named, and the string of names, half as long or less, is sorted
by recursion. Strings of names that fit in ``memory_symbols``, or that have more
names than ``alphabet``, are ranked by prefix doubling instead (each doubling one
external sort). One more induction then spreads that order to all suffixes. An
induction scans suffixes in order and gives each one's predecessor to the queue
of its first symbol; the queues form a priority queue over (symbol, arrival),
since a symbol's arrivals are in order. A tuple is (place, common prefix with
the tuple before it), and the common prefix of two arrivals is one more than the
least over the scan between them.

Text, classes, LMS places, names, ranks, tuples and orders all lie in files of a
scratch folder that belongs to the running task alone and goes when it ends; only
arrays up to ``resident`` bytes stay in memory. Beside these (some twenty at a time) there are
at most ``memory_symbols`` tuples of a queue set or of an external
sort, ``alphabet`` queue heads and chunks. Files are read in chunks or through
maps whose pages are given back: they are visited in
portions that touch no more than ``resident`` bytes. So memory doesn't grow with the text
(the test lets it grow tenfold). Common prefixes are capped at ``depth``;
suffixes equal that far may come in any order.
"""

from __future__ import annotations

import mmap
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

TUPLE = np.dtype([("at", np.int64), ("lcp", np.int32)])
PAGES = 16  # that the system maps round a touched one


class Mapped:
    """An array in a file without a name, or in memory if it is small. Reads are copies."""

    def __init__(self, folder: str, dtype, n: int, resident: int):
        self.n, self.step = n, 0
        if max(n, 1) * np.dtype(dtype).itemsize <= resident:
            self.view = np.zeros(max(n, 1), dtype)
            return
        fd, path = tempfile.mkstemp(dir=folder)
        os.close(fd)
        self.map = np.memmap(path, dtype, "w+", shape=(n,))
        os.unlink(path)
        self.view = np.asarray(self.map)
        self.step = max(64, resident // (PAGES * mmap.PAGESIZE))

    def release(self) -> None:
        if self.step:
            self.map._mmap.madvise(mmap.MADV_DONTNEED)

    def _portions(self, n: int) -> Iterator[slice]:
        step = self.step or max(n, 1)
        for k in range(0, n, step):
            yield slice(k, k + step)
            self.release()

    def take(self, places: np.ndarray) -> np.ndarray:
        if not self.step:
            return self.view[places]
        out = np.empty(len(places), self.view.dtype)
        for k in self._portions(len(places)):
            out[k] = self.view[places[k]]
        return out

    def put(self, places: np.ndarray, values: np.ndarray) -> None:
        for k in self._portions(len(places)):
            self.view[places[k]] = values[k]

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of the values in a sorted array."""
        out = np.empty(len(values), np.int64)
        for k in self._portions(len(values)):
            out[k] = np.searchsorted(self.view[: self.n], values[k])
        return out

    def part(self, a: int, b: int) -> np.ndarray:
        out = self.view[a : min(b, self.n)].copy()
        self.release()
        return out

    def write(self, at: int, values: np.ndarray) -> None:
        self.view[at : at + len(values)] = values
        self.release()


class Queue:
    """First in, first out; the middle lies on disk. Can be read backward once filling is over."""

    def __init__(self, path: str, chunk: int):
        self.path, self.chunk = path, chunk
        self.tail: list[np.ndarray] = []
        self.tail_len = self.on_disk = self.read = 0

    def __len__(self) -> int:
        return self.on_disk + self.tail_len

    def put(self, rows: np.ndarray) -> None:
        self.tail.append(rows)
        self.tail_len += len(rows)

    def flush(self) -> None:
        if self.tail_len:
            with open(self.path, "ab") as f:
                for rows in self.tail:
                    rows.tofile(f)
            self.on_disk += self.tail_len
            self.tail, self.tail_len = [], 0

    def take(self) -> np.ndarray:
        """The next tuples, a chunk at most; none when all that has arrived is read."""
        if self.read < self.on_disk:
            n = min(self.chunk, self.on_disk - self.read)
            rows = np.fromfile(self.path, TUPLE, n, offset=self.read * TUPLE.itemsize)
        else:
            rows = np.concatenate(self.tail) if self.tail else np.zeros(0, TUPLE)
            if self.tail:
                rows = rows[self.read - self.on_disk :]
        self.read += len(rows)
        return rows

    def backward(self):
        """Chunks from the end, each with its rows in reverse."""
        if self.tail:
            yield np.concatenate(self.tail)[::-1]
        at = self.on_disk
        while at:
            n = min(self.chunk, at)
            at -= n
            yield np.fromfile(self.path, TUPLE, n, offset=at * TUPLE.itemsize)[::-1]

    def forward(self):
        self.read = 0
        while len(rows := self.take()):
            yield rows


class _Spread:
    """Where the predecessors of scanned tuples go, and the least common prefix since each queue's last arrival."""

    def __init__(self, folder: str, name: str, chunk: int, depth: int, memory: int):
        self.folder, self.name, self.chunk, self.depth, self.memory = folder, name, chunk, depth, memory
        self.held = 0
        self.queues: dict[int, Queue] = {}
        self.since: dict[int, int] = {}

    def queue(self, symbol: int) -> Queue:
        if symbol not in self.queues:
            self.queues[symbol] = Queue(os.path.join(self.folder, f"{self.name}{symbol}"), self.chunk)
        return self.queues[symbol]

    def scan(self, lcp: np.ndarray, places: np.ndarray, symbols: np.ndarray, goes: np.ndarray) -> None:
        """``lcp`` of a scanned batch; ``places``/``symbols`` of the predecessors that ``goes`` selects."""
        least = int(lcp.min())
        source = np.flatnonzero(goes)
        if not len(source):
            for s in self.since:
                if self.since[s] > least:
                    self.since[s] = least
            return
        order = np.argsort(symbols, kind="stable")
        source, symbols, places = source[order], symbols[order], places[order]
        first = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        stop = np.append(first[1:], len(symbols))
        value = np.empty(len(source), np.int64)
        if len(source) > 1:
            value[1:] = _range_min(lcp, np.where(symbols[1:] == symbols[:-1], source[:-1] + 1, source[1:]), source[1:])
        ahead = np.minimum.accumulate(lcp)
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.depth)
        touched = symbols[first].tolist()
        seen = dict(zip(touched, (int(x) for x in after[source[stop - 1] + 1]), strict=True))
        for s, a, b in zip(touched, first.tolist(), stop.tolist(), strict=True):
            value[a] = min(self.since.get(s, -1), int(ahead[source[a]]))
            rows = np.empty(b - a, TUPLE)
            rows["at"] = places[a:b]
            rows["lcp"] = np.minimum(value[a:b] + 1, self.depth)
            self.queue(s).put(rows)
        self.held += len(source)
        if self.held > self.memory:
            for queue in self.queues.values():
                queue.flush()
            self.held = 0
        for s in self.since:
            self.since[s] = seen[s] if s in seen else min(self.since[s], least)
        for s in touched:
            self.since.setdefault(s, seen[s])


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi], both ends included, by doubling."""
    width = hi - lo + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out, table, step = np.empty(len(lo), np.int64), values, 1
    for k in range(int(level.max()) + 1):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[lo[here]], table[hi[here] - step + 1])
        if 2 * step <= len(values):
            table = np.minimum(table[: len(table) - step], table[step:])
            step *= 2
    return out


class Sorter:
    """Sorts the suffixes of one text. Use as a context manager; the scratch folder goes at exit."""

    def __init__(self, depth: int, memory_symbols: int = 1 << 20, chunk: int = 1 << 17, folder: str | None = None, alphabet: int = 4096, resident: int = 16 << 20):
        self.depth, self.memory, self.chunk, self.alphabet, self.resident = depth, memory_symbols, chunk, alphabet, resident
        self.folder = tempfile.mkdtemp(prefix="induced-", dir=folder)

    def __enter__(self) -> Sorter:
        return self

    def __exit__(self, *_) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def mapped(self, dtype, n: int) -> Mapped:
        """An array of the scratch folder."""
        return Mapped(self.folder, dtype, n, self.resident)

    def _spans(self, n: int, size: int | None = None) -> Iterator[tuple[int, int]]:
        size = size or self.chunk
        return ((a, min(n, a + size)) for a in range(0, n, size))

    def sort(self, text: np.ndarray):
        """Yields (places, common prefixes with the place before) in suffix order.

        ``text`` holds symbols above 0, in memory or mapped; a least symbol is
        added behind it and its suffix is left out of the output.
        """
        whole = self.mapped(text.dtype, len(text) + 1)
        for a, b in self._spans(len(text)):
            whole.write(a, text[a:b])
        whole.write(len(text), np.zeros(1, text.dtype))
        skipped = False
        for rows in self._sorted(whole):
            if not skipped and len(rows):
                rows, skipped = rows[1:], True
            if len(rows):
                yield rows["at"], rows["lcp"]

    def _sorted(self, text: Mapped) -> Iterator[np.ndarray]:
        rising = self._classes(text)
        symbols = np.zeros(0, text.view.dtype)
        n_lms = 0
        for a, b in self._spans(text.n):
            symbols = np.union1d(symbols, text.part(a, b))
            n_lms += int(self._opens(rising, a, b).sum())
        lms = self.mapped(np.int64, max(n_lms, 1))
        lms.write(0, np.array([text.n - 1]))
        at = 0
        for a, b in self._spans(text.n):
            here = np.flatnonzero(self._opens(rising, a, b)) + a
            lms.write(at, here)
            at += len(here)
        symbols = [int(s) for s in symbols]
        places, lcps = self._lms_order(text, rising, lms, symbols)
        return self._induce(text, rising, places, lcps, symbols)

    def _classes(self, text: Mapped) -> Mapped:
        """1 where a suffix rises; the last symbol is unique and least."""
        n = text.n
        out = self.mapped(np.uint8, n)
        later = True
        out.write(n - 1, np.ones(1, np.uint8))
        stop = n - 1
        while stop:
            start = max(0, stop - self.chunk)
            here = text.part(start, stop + 1).astype(np.int64)
            sign = np.sign(here[1:] - here[:-1])
            known = np.where(sign != 0, np.arange(len(sign)), len(sign))
            nearest = np.minimum.accumulate(known[::-1])[::-1]
            rising = np.where(nearest < len(sign), np.append(sign, 0)[nearest] > 0, later)
            out.write(start, rising)
            later = bool(rising[0])
            stop = start
        return out

    @staticmethod
    def _opens(rising: Mapped, a: int, b: int) -> np.ndarray:
        """Which of the places a..b-1 are LMS places."""
        here = rising.part(max(a - 1, 0), b).astype(bool)
        if not a:
            here = np.append(True, here)
        return here[1:] & ~here[:-1]

    def _by_key(self, key: Callable[[int, int], np.ndarray], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, numbers) of 0..n-1 in the order of their keys, then numbers: sorted runs on disk, merged by key ranges."""
        keys, numbers = self.mapped(np.uint64, n), self.mapped(np.int64, n)
        runs = list(self._spans(n, self.memory))
        top = 0
        for a, b in runs:
            k = key(a, b).astype(np.uint64)
            order = np.argsort(k, kind="stable")
            keys.write(a, k[order])
            numbers.write(a, order + a)
            top = max(top, int(k.max()))
        todo = [(0, top, [a for a, _ in runs], [b for _, b in runs])]
        while todo:
            low, high, starts, stops = todo.pop()
            total = sum(stops) - sum(starts)
            if total <= self.memory or low == high:
                parts = [(a, b) for a, b in zip(starts, stops, strict=True) if a < b]
                if low == high:  # one key: in order as they are
                    for x, y in parts:
                        for a, b in self._spans(y - x):
                            yield keys.part(x + a, x + b), numbers.part(x + a, x + b)
                elif parts:
                    k, at = (np.concatenate([m.part(a, b) for a, b in parts]) for m in (keys, numbers))
                    order = np.argsort(k, kind="stable")
                    for a, b in self._spans(len(order)):
                        yield k[order[a:b]], at[order[a:b]]
                continue
            middle = (low + high) // 2
            cuts = [a + int(np.searchsorted(keys.view[a:b], np.uint64(middle), "right")) for a, b in zip(starts, stops, strict=True)]
            keys.release()
            todo += [(middle + 1, high, cuts, stops), (low, middle, starts, cuts)]

    def _common(self, text: Mapped, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Common prefixes of suffix pairs, known to be equal for ``start`` symbols."""
        n, out = text.n, np.minimum(start, self.depth).astype(np.int64)
        live = np.flatnonzero(out < self.depth)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            same = (x < n) & (y < n)
            same[same] = text.take(x[same]) == text.take(y[same])
            live = live[same]
            out[live] += 1
            live = live[out[live] < self.depth]
        return out

    def _doubled(self, names: Mapped) -> tuple[Mapped, Mapped]:
        """Order and common prefixes of a string of names 0, 1, ... by prefix doubling."""
        n = names.n
        order, lcp = self.mapped(np.int64, n), self.mapped(np.int64, n)
        ranks, span, distinct = [names], 1, 0

        def sorted_by(key: Callable[[int, int], np.ndarray], rank: Mapped | None) -> int:
            at, last, count = 0, None, -1
            for k, numbers in self._by_key(key, n):
                new = np.append(last is None or k[0] != last, k[1:] != k[:-1])
                value = count + np.cumsum(new)
                count, last = int(value[-1]), k[-1]
                order.write(at, numbers)
                at += len(numbers)
                if rank is not None:
                    rank.put(numbers, value)
            return count + 1

        def pair(rank: Mapped, span: int) -> Callable[[int, int], np.ndarray]:
            def key(a: int, b: int) -> np.ndarray:
                second = np.zeros(b - a, np.int64)
                later = rank.part(min(a + span, n), min(b + span, n))
                second[: len(later)] = later + 1
                return rank.part(a, b) * (n + 1) + second

            return key

        if self.depth < 2:
            sorted_by(names.part, None)
        while span < self.depth and distinct < n:
            rank = self.mapped(np.int64, n)
            distinct = sorted_by(pair(ranks[-1], span), rank)
            ranks.append(rank)
            span *= 2
        for a, b in self._spans(n - 1):
            x, y = order.part(a, b), order.part(a + 1, b + 1)
            shared = np.zeros(b - a, np.int64)
            for k in range(len(ranks) - 1, -1, -1):
                same = (x < n) & (y < n)
                same[same] = ranks[k].take(x[same]) == ranks[k].take(y[same])
                step = same * (1 << k)
                shared, x, y = shared + step, x + step, y + step
            lcp.write(a + 1, np.minimum(shared, self.depth))
        return order, lcp

    def _lms_order(self, text: Mapped, rising: Mapped, lms: Mapped, symbols: list[int]) -> tuple[Mapped, Mapped]:
        """LMS places in suffix order with the common prefixes of neighbours."""
        n = lms.n
        seeds, order, name = (self.mapped(np.int64, n) for _ in range(3))
        at = 0
        for _, numbers in self._by_key(lambda a, b: text.take(lms.part(a, b)), n):
            seeds.write(at, lms.take(numbers))
            at += len(numbers)
        at = 0
        for rows in self._induce(text, rising, seeds, None, symbols):
            places = rows["at"]
            opens = (places > 0) & (rising.take(places) == 1) & (rising.take(np.maximum(places - 1, 0)) == 0)
            if n == 1:
                opens = places == text.n - 1
            order.write(at, places[opens])
            at += int(opens.sum())

        def sized(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            number = lms.find(places)
            return number, lms.take(np.minimum(number + 1, n - 1)) - places

        count, before = -1, None
        for a, b in self._spans(n):
            places = order.part(a, b)
            number, size = sized(places)
            x, size_x = (places[:-1], size[:-1]) if before is None else (np.append(before[0], places[:-1]), np.append(before[1], size[:-1]))
            y, size_y = (places[1:], size[1:]) if before is None else (places, size)
            differ = size_x != size_y
            live, k = np.flatnonzero(~differ), 0
            while len(live):
                differ[live] = text.take(x[live] + k) != text.take(y[live] + k)
                live = live[~differ[live] & (k < size_x[live])]
                k += 1
            value = count + np.cumsum(np.append(True, differ) if before is None else differ)
            name.put(number, value)
            count, before = int(value[-1]), (places[-1], size[-1])
        known = count + 1 < n
        if known:
            if n > self.memory and count < self.alphabet:
                sub_order, sub_lcp = self.mapped(np.int64, n), self.mapped(np.int64, n)
                at = 0
                for rows in self._sorted(name):
                    sub_order.write(at, rows["at"])
                    sub_lcp.write(at, rows["lcp"])
                    at += len(rows)
            else:
                sub_order, sub_lcp = self._doubled(name)
            for a, b in self._spans(n):
                order.write(a, lms.take(sub_order.part(a, b)))
        lcps = self.mapped(np.int64, n)
        for a, b in self._spans(n - 1):
            shared = np.zeros(b - a, np.int64)
            if known:  # equal names stand for equal text from one LMS place to the next
                number = sub_order.part(a + 1, b + 1)
                shared = lms.take(np.minimum(number + sub_lcp.part(a + 1, b + 1), n - 1)) - lms.take(number)
            lcps.write(a + 1, self._common(text, order.part(a, b), order.part(a + 1, b + 1), shared))
        return order, lcps

    def _induce(self, text: Mapped, rising: Mapped, seeds: Mapped, seed_lcp: Mapped | None, symbols: list[int]) -> Iterator[np.ndarray]:
        """All suffixes in order from the LMS suffixes in order, as TUPLE chunks. Without ``seed_lcp`` these are 0."""
        folder = tempfile.mkdtemp(dir=self.folder)
        falls, rises = (_Spread(folder, x, self.chunk, self.depth, self.memory) for x in "ls")
        seeds_of: dict[int, list[int]] = {}
        for a, b in self._spans(seeds.n):
            symbol = text.take(seeds.part(a, b))
            first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
            for s, x, y in zip(symbol[first].tolist(), first.tolist(), np.append(first[1:], len(symbol)).tolist(), strict=True):
                seeds_of.setdefault(s, [a + x, 0])[1] = a + y

        def one(place: int, other: int) -> int:
            return int(self._common(text, np.array([place]), np.array([other]), np.array([0]))[0])

        def give(spread: _Spread, places: np.ndarray, lcp: np.ndarray, want_rising: bool) -> None:
            before = places - 1
            goes = (before >= 0) & (rising.take(np.maximum(before, 0)) == want_rising)
            j = before[goes]
            spread.scan(lcp.astype(np.int64), j, text.take(j).astype(np.int64), goes)

        for s in symbols:
            last = None
            queue = falls.queues.get(s)
            if queue is not None:
                # An empty queue's first tuple follows another symbol.
                fresh = True
                while len(rows := queue.take()):
                    lcp = rows["lcp"].copy()
                    if fresh:
                        lcp[0], fresh = 0, False
                    give(falls, rows["at"], lcp, False)
                    last = int(rows["at"][-1])
                    queue = falls.queues[s]
            if s in seeds_of:
                a, b = seeds_of[s]
                for at in range(a, b, self.chunk):
                    places = seeds.part(at, min(b, at + self.chunk))
                    lcp = seed_lcp.part(at, min(b, at + self.chunk)) if seed_lcp else np.zeros(len(places), np.int64)
                    if at == a:
                        lcp[0] = one(int(places[0]), last) if last is not None else 0
                    give(falls, places, lcp, False)

        end = np.zeros(1, TUPLE)
        end["at"] = text.n - 1
        rises.queue(int(text.view[text.n - 1])).put(end)
        for s in reversed(symbols):
            last = None
            queue = rises.queues.get(s)
            if queue is not None:
                fresh = True
                while len(rows := queue.take()):
                    lcp = rows["lcp"].copy()
                    if fresh:
                        lcp[0], fresh = 0, False
                    give(rises, rows["at"], lcp, True)
                    last = int(rows["at"][-1])
            if s in falls.queues:
                carried = None
                for rows in falls.queues[s].backward():
                    lcp = np.empty(len(rows), np.int64)
                    lcp[1:] = rows["lcp"][:-1]
                    if carried is None:
                        lcp[0] = one(int(rows["at"][0]), last) if last is not None else 0
                    else:
                        lcp[0] = carried
                    carried = int(rows["lcp"][-1])
                    give(rises, rows["at"], lcp, True)

        for s in symbols:
            last, fresh = None, True
            if s in falls.queues:
                for rows in falls.queues[s].forward():
                    out = rows.copy()
                    if fresh:
                        out["lcp"][0], fresh = 0, False
                    last = int(out["at"][-1])
                    yield out
            if s in rises.queues:
                carried, queue = None, rises.queues[s]
                for rows in queue.backward():
                    made = np.empty(len(rows), TUPLE)
                    made["at"] = rows["at"]
                    # In a descending queue a tuple's value is shared with the larger one before it.
                    made["lcp"][1:] = rows["lcp"][:-1]
                    made["lcp"][0] = carried if carried is not None else (one(int(rows["at"][0]), last) if last is not None else 0)
                    carried = int(rows["lcp"][-1])
                    yield made
        shutil.rmtree(folder, ignore_errors=True)

