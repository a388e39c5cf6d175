"""Suffix and common-prefix arrays by external induced sorting.

Sorted S* suffixes induce the L suffixes in ascending order, these the S
suffixes in descending order. Both scans are driven by a priority queue whose
entries (key, order of arrival, position, common prefix with the entry before)
lie on disk but for the range of keys that is being scanned. S* suffixes are
put in order by naming their substrings, sorted by the same two scans, and
recursion on the names.

Texts, kinds, names, queues and results are arrays in temporary files wherever
they have more than `memory_rows` entries; what is held in memory at a time is
a small multiple of `memory_rows`, however long the text is.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

FAR = np.int64(1) << 40
NAMES = 4  # times memory_rows: names that are put in order in memory
INNER = 1024  # rows of a range that is kept in order, into which others are inserted


def array(n: int, dtype, memory_rows: int) -> np.ndarray:
    """An empty array, in a temporary file if it is long; the operating system removes the file with the array."""
    if n <= memory_rows:
        return np.empty(n, dtype)
    with tempfile.TemporaryFile(prefix="sort-") as f:
        return np.memmap(f, dtype, "w+", shape=(n,)).view(np.ndarray)


def holding(top: int):
    """The smallest type for numbers from 0 to `top`."""
    return np.uint8 if top < 1 << 8 else np.int32 if top < 1 << 31 else np.int64


def holding_signed(top: int):
    return np.int16 if top < 1 << 15 else np.int64


def blocks(n: int, size: int) -> Iterator[slice]:
    for i in range(0, n, size):
        yield slice(i, min(n, i + size))


class DiskQueue:
    """Priority queue of (key, position, prefix); first in, first out among equal keys. Taken keys never fall.

    `counts` says how often each key, from `first` on, arrives at most. By it,
    keys are dealt into ranges of about `share` rows; a key with more than
    that has a range of its own. The range in front is in memory: in order if
    it is small, in a queue of its own with smaller ranges if not, and one run
    after another if it is one key. Of the others, up to `most` rows wait in
    memory; then all of them go to one temporary file.
    """

    def __init__(self, counts: np.ndarray, most: int, share: int, first: int = 0) -> None:
        start = np.cumsum(counts) - counts
        _, self.range_of = np.unique(start // share * 2 + (counts > share), return_inverse=True)
        n = int(self.range_of[-1]) + 1 if len(counts) else 0
        self.counts, self.most, self.share, self.first = counts, most, share, first
        self.single = np.bincount(self.range_of, minlength=n) == 1
        self.parts: list[list] = [[] for _ in range(n)]
        self.low = np.full(n + 1, FAR)
        self.held, self.front, self.next = 0, -1, 0
        self.file, self.end, self.spills = None, 0, 0
        self.rows, self.inner = np.zeros((3, 0), np.int64), None

    def push(self, rows: np.ndarray) -> None:
        """Add (keys, positions, prefixes) whose keys are in order; within a key they are in order of arrival."""
        at = self.range_of[rows[0] - self.first]
        cuts = np.flatnonzero(np.diff(at)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), rows.shape[1]], strict=True):
            r, part = int(at[lo]), rows[:, lo:hi]
            if r != self.front or self.single[r]:
                self.parts[r].append(part)
                self.low[r] = min(self.low[r], int(part[0, 0]))
                self.held += hi - lo
            elif self.inner:
                self.inner.push(part)
            else:
                place = np.searchsorted(self.rows[0], part[0], "right")
                self.rows = np.insert(self.rows, place, part, axis=1)
        if self.held > self.most:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="queue-")
        self.spills += 1
        self.file.seek(self.end)
        for parts in self.parts:
            fresh = [p for p in parts if isinstance(p, np.ndarray)]
            if fresh:
                whole = np.concatenate(fresh, axis=1)
                data = whole.astype(holding(int(whole.max()) | 1 << 8))
                self.file.write(data.tobytes())
                parts[:] = [*[p for p in parts if not isinstance(p, np.ndarray)], (self.end, whole.shape[1], data.dtype)]
                self.end += data.nbytes
        self.held = 0

    def loaded(self, part) -> np.ndarray:
        if isinstance(part, tuple):
            self.file.seek(part[0])
            return np.frombuffer(self.file.read(3 * part[2].itemsize * part[1]), part[2]).reshape(3, part[1]).astype(np.int64)
        self.held -= part.shape[1]
        return part

    def least(self) -> int:
        """The least key; FAR if the queue is empty."""
        if self.rows.shape[1]:
            return int(self.rows[0, 0])
        if self.inner and (key := self.inner.least()) < FAR:
            return key
        at = max(self.front, 0)
        self.next = at + int(np.argmin(self.low[at:] == FAR))  # the first range that has rows
        return int(self.low[self.next])

    def bring(self) -> None:
        """The range of the least key to the front, of a range of one key the next run."""
        if self.rows.shape[1] or self.inner and self.inner.least() < FAR or self.least() == FAR:
            return
        r, self.inner = self.next, None
        self.front = r
        if self.single[r]:
            self.rows = self.loaded(self.parts[r].pop(0))  # of `most` rows and one push at most
            self.low[r] = self.low[r] if self.parts[r] else FAR
            return
        whole = np.concatenate([self.loaded(p) for p in self.parts[r]], axis=1)
        self.parts[r], self.low[r] = [], FAR
        whole = whole[:, np.argsort(whole[0], kind="stable")]
        if self.share > 4 * INNER:
            lo, hi = np.searchsorted(self.range_of, [r, r + 1])
            self.inner = DiskQueue(self.counts[lo:hi], int(FAR), INNER, self.first + int(lo))
            self.inner.push(whole)
        else:
            self.rows = whole

    def seen(self, many: int) -> tuple[np.ndarray, int, bool]:
        """(the first rows, `many` at most; the key below which these are all rows there are; whether they are a run of one key)."""
        self.bring()
        if self.inner:
            rows, bound, single = self.inner.seen(many)
            return rows, min(bound, int(self.low[self.front + 1 :].min())), single
        if not self.rows.shape[1]:
            return self.rows, int(FAR), False
        bound = int(self.rows[0, many]) if self.rows.shape[1] > many else int(self.low[self.front + 1 :].min())
        return self.rows[:, :many], bound, bool(self.single[self.front])

    def drop(self, n: int) -> None:
        """Leave out the first n rows that were seen."""
        if self.inner:
            self.inner.drop(n)
        else:
            self.rows = self.rows[:, n:]

    def pop(self) -> np.ndarray:
        """Entries of the least key, in order of arrival; more of them may follow."""
        self.bring()
        if self.inner:
            return self.inner.pop()
        n = int(np.searchsorted(self.rows[0], self.rows[0, 0], "right"))
        got, self.rows = self.rows[:, :n], self.rows[:, n:]
        return got

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class RangeMinimum:
    """Minima of ranges lo..hi (both included) by a table of minima over powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 ** len(self.rows) <= len(values):
            half, last = 2 ** (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), np.int64)
        level = np.log2(hi - lo + 1).astype(np.int64)
        for k in np.unique(level):
            m = level == k
            row = self.rows[k]
            out[m] = np.minimum(row[lo[m]], row[hi[m] - 2**k + 1])
        return out


class Prefixes:
    """Common prefixes of suffixes, up to `most` and the next stop, read off the text eight symbols at a time where these are bytes and stops are 0."""

    def __init__(self, text: np.ndarray, stop: np.ndarray, most: int) -> None:
        self.most, self.text, self.stop, self.words = most, text, stop, None
        if text.dtype == np.uint8 and len(text) > 8:
            # every position as the start of an eight-byte word, without a copy
            self.words = np.ndarray((len(text) - 7,), "<u8", buffer=text, strides=(1,))

    def word(self, at: np.ndarray) -> np.ndarray:
        last = len(self.words) - 1
        beyond = np.maximum(at - last, 0)
        # near the end, the last word without its first symbols; what follows it is stops
        return self.words[at - beyond] >> (np.minimum(beyond, 7) * 8).astype(np.uint64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        live, step = np.arange(len(a)), 1 if self.words is None else 8
        low, high, one = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080), np.uint64(1)
        for d in range(0, self.most, step):
            x, y = a[live] + d, b[live] + d
            if self.words is None:
                live = live[(self.text[x] == self.text[y]) & ~self.stop[x] & ~self.stop[y]]
                out[live] += 1
            else:
                x, y = self.word(x), self.word(y)
                end = (x ^ y) | ((x - low) & ~x & high)  # where the two differ, or the first stops
                whole = end == 0
                part = end[~whole]
                out[live[~whole]] += np.bitwise_count((part & (~part + one)) - one) // 8
                live = live[whole]
                out[live] += 8
            if not len(live):
                break
        return np.minimum(out, self.most)


class Scan:
    """One scan: what the seeds induce, in order, and common prefixes with the one before.

    Keys are the symbols, counted from the top if `down`. A scanned suffix
    puts the position before it into the queue if that is `allowed`. Suffixes
    of a key that were induced are scanned before its seeds. Without `seam`,
    common prefixes are left out, and keys are taken many at a time as far as
    none of them induces another.
    """

    def __init__(self, text, allowed, symbols: int, down: bool, seam: Prefixes | None, memory_rows: int) -> None:
        self.text, self.allowed, self.top, self.down, self.seam, self.rows = text, allowed, symbols - 1, down, seam, memory_rows
        counts = np.zeros(symbols, np.int64)
        for part in blocks(len(text), memory_rows):
            counts += np.bincount(self.keys(np.flatnonzero(allowed[part]) + part.start), minlength=symbols)
        self.queue = DiskQueue(counts, memory_rows, max(1, memory_rows // 4))
        total = int(counts.sum())
        self.found, self.end = array(total, holding(len(text)), memory_rows), 0
        self.lengths = array(total if seam else 0, holding(seam.most if seam else 0), memory_rows)
        self.narrow = holding_signed(self.top)
        self.running = np.full(symbols if seam else 0, -1, np.int64)  # per key, the least prefix since its last entry; -1: no entry yet

    def keys(self, at: np.ndarray) -> np.ndarray:
        symbol = self.text[at].astype(np.int64)
        return self.top - symbol if self.down else symbol

    def keep(self, position: np.ndarray, prefix: np.ndarray | None = None) -> None:
        self.found[self.end : self.end + len(position)] = position
        if prefix is not None:
            self.lengths[self.end : self.end + len(position)] = prefix
        self.end += len(position)

    def induced(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the positions induce the one before, keys of these)."""
        at = np.flatnonzero(position > 0)
        at = at[self.allowed[position[at] - 1]]
        return at, self.keys(position[at] - 1)

    def step(self, position: np.ndarray, prefix: np.ndarray) -> None:
        at, key = self.induced(position)
        order = np.argsort(key.astype(self.narrow), kind="stable")  # few keys sort by radix
        at, key = at[order], key[order]
        carried = np.zeros(len(at), np.int64)
        if self.seam:
            whole = int(prefix.min())
            if len(at):
                first = np.ones(len(at), bool)
                first[1:] = key[1:] != key[:-1]
                inner, head = np.flatnonzero(~first), np.flatnonzero(first)
                carried[inner] = RangeMinimum(prefix)(at[inner - 1] + 1, at[inner])
                carried[head] = np.minimum(self.running[key[head]], np.minimum.accumulate(prefix)[at[head]])
                carried = np.minimum(carried + 1, self.seam.most)
                last = np.append(head[1:] - 1, len(at) - 1)
                since = np.append(np.minimum.accumulate(prefix[::-1])[::-1], FAR)[at[last] + 1]
            np.minimum(self.running, whole, out=self.running)
            if len(at):
                self.running[key[last]] = since
        if len(at):
            self.queue.push(np.stack([key, position[at] - 1, carried]))

    def run(self, seeds: np.ndarray, prefixes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """`seeds` are in order of the scan."""
        done, many = 0, 512
        ahead, start = np.zeros(0, np.int64), 0  # keys of the seeds from `start` on

        while True:
            if done >= start + len(ahead) and done < len(seeds):
                start, ahead = done, self.keys(seeds[done : done + self.rows])
            seed = int(ahead[done - start]) if done < len(seeds) else FAR
            key = min(self.queue.least(), seed)
            if key == FAR:
                break
            if not self.seam and self.top > 255:  # of few keys, each induces most others
                done, alone, full = self.many_keys(seeds, ahead, start, done, many)
                many = min(2 * many, self.rows) if full else max(512, many // 2)
                if not alone:
                    continue
            previous = None
            while self.queue.least() == key:
                _, position, prefix = self.queue.pop()
                self.keep(position, prefix if self.seam else None)
                previous = position[-1:]
                self.step(position, prefix)
            opened = True
            while seed == key:
                n = done + int(np.searchsorted(ahead[done - start :], key, "right"))
                own = seeds[done:n].astype(np.int64)
                prefix = np.zeros(len(own), np.int64)
                if self.seam:
                    prefix = prefixes[done:n].astype(np.int64)
                    if opened:
                        prefix[0] = self.seam(previous, own[:1])[0] if previous is not None else 0
                self.step(own, prefix)
                done, opened = n, False
                if done >= start + len(ahead) and done < len(seeds):
                    start, ahead = done, self.keys(seeds[done : done + self.rows])
                seed = int(ahead[done - start]) if done < len(seeds) else FAR
        self.queue.close()
        if self.end != len(self.found):
            raise AssertionError(f"{self.end} of {len(self.found)} suffixes were induced")
        return self.found, self.lengths

    def many_keys(self, seeds, ahead, start: int, done: int, many: int) -> tuple[int, bool, bool]:
        """Scan as many keys at once as are free of each other: (seeds done, whether the next key has to go alone, whether all that were looked at went)."""
        q, own = self.queue, ahead[done - start : done - start + many]
        if q.least() <= (own[0] if len(own) else FAR):
            rows, bound, single = q.seen(many)
            if single:
                return done, True, False
        else:  # the queue's front has to stay behind the seeds
            rows, bound = np.zeros((3, 0), np.int64), q.least()
        if done + len(own) < len(seeds):
            bound = min(bound, int(ahead[done - start + many]) if done - start + many < len(ahead) else int(own[-1]))
        rows, own = rows[:, rows[0] < bound], own[own < bound]
        if not rows.shape[1] and not len(own):
            return done, True, False
        keys = np.concatenate([rows[0], own])
        position = np.concatenate([rows[1], seeds[done : done + len(own)].astype(np.int64)])
        seeded = np.repeat([False, True], [rows.shape[1], len(own)])
        order = np.argsort(2 * keys + seeded, kind="stable")
        keys, position, seeded = keys[order], position[order], seeded[order]
        at, key = self.induced(position)
        inside = key[key < bound]
        full = not len(inside)
        if not full:
            n = int(np.searchsorted(keys, inside.min()))
            if not n:
                return done, True, False
            keys, position, seeded = keys[:n], position[:n], seeded[:n]
            key, at = key[at < n], at[at < n]
        taken = int((~seeded).sum())
        if taken:
            q.drop(taken)
        self.keep(position[~seeded])
        if len(at):
            order = np.argsort(key, kind="stable")
            q.push(np.stack([key[order], position[at[order]] - 1, np.zeros(len(at), np.int64)]))
        return done + len(keys) - taken, False, full


def kinds(text: np.ndarray, stop: np.ndarray, memory_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(is S, is S*) of each position, from the end to the start. Stops are S*, and smaller than all else."""
    n = len(text)
    s, star = array(n, bool, memory_rows), array(n, bool, memory_rows)
    after, after_s = np.int64(0), True
    for part in reversed(list(blocks(n, memory_rows))):
        own = np.where(stop[part], np.int64(-1), text[part].astype(np.int64))
        rises = np.sign(np.append(own[1:], after) - own)
        rises[stop[part]] = 1
        if part.stop == n:
            rises[-1] = 1
        place = np.where(rises != 0, np.arange(len(own)), len(own))
        place = np.minimum.accumulate(place[::-1])[::-1]
        s[part] = np.append(rises > 0, after_s)[place]
        after, after_s = own[0], bool(s[part.start])
    for part in blocks(n, memory_rows):
        before = np.append(s[part.start - 1] if part.start else True, s[part][:-1])
        star[part] = s[part] & ~before | stop[part]
    return s, star


def places_of(mask: np.ndarray, memory_rows: int) -> np.ndarray:
    total = sum(int(np.count_nonzero(mask[p])) for p in blocks(len(mask), memory_rows))
    out, end = array(total, holding(len(mask)), memory_rows), 0
    for p in blocks(len(mask), memory_rows):
        own = np.flatnonzero(mask[p]) + p.start
        out[end : end + len(own)] = own
        end += len(own)
    return out


def by_symbol(places: np.ndarray, text: np.ndarray, symbols: int, memory_rows: int) -> np.ndarray:
    """Places in order of their symbols, those of one symbol in the order given (a counting sort)."""
    counts = np.zeros(symbols + 1, np.int64)
    for p in blocks(len(places), memory_rows):
        counts[1:] += np.bincount(text[places[p]], minlength=symbols)
    at = np.cumsum(counts)
    out = array(len(places), places.dtype, memory_rows)
    for p in blocks(len(places), memory_rows):
        own = places[p]
        symbol = text[own].astype(np.int64)
        order = np.argsort(symbol.astype(holding_signed(symbols)), kind="stable")
        symbol = symbol[order]
        first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        size = np.diff(np.append(first, len(symbol)))
        out[np.repeat(at[symbol[first]] - first, size) + np.arange(len(symbol))] = own[order]
        at[symbol[first]] += size
    return out


def named(text: np.ndarray, stop: np.ndarray, star: np.ndarray, ranked: np.ndarray, memory_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(S* positions, their names, which are stops, whether names are unique); equal substrings, from one S* position to the next, get equal names. `ranked` has the S* positions that are no stops in order of their substrings."""
    places = places_of(star, memory_rows)
    ends = array(len(places), bool, memory_rows)
    names = array(len(places), holding(len(places) | 1 << 8), memory_rows)  # never bytes, which have stops of one symbol
    n_stops = 0
    for p in blocks(len(places), memory_rows):
        ends[p] = stop[places[p]]
        names[p] = n_stops + np.cumsum(ends[p]) - 1
        n_stops += int(ends[p].sum())
    name, last, last_size, unique = n_stops - 1, None, -1, True
    for p in blocks(len(ranked), memory_rows):
        own = ranked[p].astype(np.int64)
        at = np.searchsorted(places, own)
        size = np.append(places, len(text) - 1)[at + 1] - own if len(places) <= memory_rows else np.where(at + 1 < len(places), places[np.minimum(at + 1, len(places) - 1)], len(text) - 1) - own
        before = np.append(-1 if last is None else last, own[:-1])
        pair = np.flatnonzero(size == np.append(last_size, size[:-1]))
        equal, live = np.ones(len(pair), bool), np.arange(len(pair))
        d = 0
        while len(live):
            x, y = own[pair[live]] + d, before[pair[live]] + d
            differ = (text[x] != text[y]) & ~(stop[x] & stop[y])
            equal[live[differ]] = False
            d += 1
            live = live[~differ]
            live = live[size[pair[live]] >= d]
        new = np.ones(len(own), bool)
        new[pair[equal]] = False
        number = name + np.cumsum(new)
        names[at] = number
        unique &= bool(new.all())
        name, last, last_size = int(number[-1]), own[-1], int(size[-1])
    return places, names, ends, unique


def star_order(text: np.ndarray, stop: np.ndarray, s: np.ndarray, star: np.ndarray, symbols: int, memory_rows: int, levels: list | None) -> np.ndarray:
    """The S* positions that are no stops, in order of their suffixes."""
    inner = array(len(text), bool, memory_rows)
    for p in blocks(len(text), memory_rows):
        inner[p] = star[p] & ~stop[p]
    order = two_scans(text, stop, s, places_of(inner, memory_rows), None, symbols, memory_rows, levels)
    ranked = picked(order, star, memory_rows)
    del order
    if not len(ranked):
        return ranked
    places, names, ends, unique = named(text, stop, star, ranked, memory_rows)
    if unique:
        return ranked
    del ranked
    if levels is not None:
        levels.append(len(names))
    if len(names) <= NAMES * memory_rows:
        order = doubled(names.astype(np.int64))
        return places[order[~ends[order]]]
    top = 1 + max(int(names[p].max()) for p in blocks(len(names), memory_rows))
    s2, star2 = kinds(names, ends, memory_rows)
    stars2 = star_order(names, ends, s2, star2, top, memory_rows, levels)
    order = two_scans(names, ends, s2, stars2, None, top, memory_rows, levels)
    out = array(len(order), places.dtype, memory_rows)
    for p in blocks(len(order), memory_rows):
        out[p] = places[order[p]]
    return out


def picked(order: np.ndarray, mask: np.ndarray, memory_rows: int) -> np.ndarray:
    """The entries of `order` whose mask is set."""
    total = sum(int(np.count_nonzero(mask[order[p]])) for p in blocks(len(order), memory_rows))
    out, end = array(total, order.dtype, memory_rows), 0
    for p in blocks(len(order), memory_rows):
        own = order[p]
        own = own[mask[own]]
        out[end : end + len(own)] = own
        end += len(own)
    return out


def doubled(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names that fits in memory, by doubling. Its last name is unique."""
    n = len(names)
    order = np.argsort(names)
    h = 1
    while True:
        rank = np.empty(n, np.int64)
        value = names[order]
        rank[order] = np.cumsum(np.append(0, value[1:] != value[:-1]))
        if rank[order[-1]] == n - 1:
            return order
        second = np.append(rank[h:], np.full(min(h, n), -1))[:n]
        names = rank * (n + 1) + second + 1
        order = np.argsort(names)
        h *= 2


def two_scans(text, stop, s, stars, most: int | None, symbols: int, memory_rows: int, levels: list | None):
    """All positions but stops in order of their suffixes, given the S* positions in order.

    With `most`, (positions, common prefixes up to `most`) of all; without it
    the order alone. Unsorted S* positions give the order of S* substrings.
    """
    n = len(text)
    seam = None if most is None else Prefixes(text, stop, most)
    stars, stops = by_symbol(stars, text, symbols, memory_rows), places_of(stop, memory_rows)
    seeds = array(len(stops) + len(stars), holding(n), memory_rows)
    seeds[: len(stops)], seeds[len(stops) :] = stops, stars
    prefix = None
    if most is not None:
        prefix = array(len(seeds), holding(most), memory_rows)
        prefix[: len(stops) + 1] = 0
        for p in blocks(max(0, len(stars) - 1), memory_rows):
            prefix[len(stops) + 1 + p.start : len(stops) + 1 + p.stop] = seam(stars[p].astype(np.int64), stars[p.start + 1 : p.stop + 1].astype(np.int64))
    allowed = array(n, bool, memory_rows)
    for p in blocks(n, memory_rows):
        allowed[p] = ~s[p] & ~stop[p]
    up = Scan(text, allowed, symbols, False, seam, memory_rows)
    low, low_prefix = up.run(seeds, prefix)
    for p in blocks(n, memory_rows):
        allowed[p] = s[p] & ~stop[p]
    turned = None
    if most is not None:  # prefixes with the one after, as the scan goes down
        turned = array(len(low), low_prefix.dtype, memory_rows)
        turned[:1] = 0
        turned[1:] = low_prefix[::-1][:-1]
    back = Scan(text, allowed, symbols, True, seam, memory_rows)
    high, high_prefix = back.run(low[::-1], turned)
    if levels is not None:
        levels.append((up.queue.spills, back.queue.spills))
    # within a symbol, L suffixes come before S suffixes
    counts = np.zeros((2, symbols + 1), np.int64)
    for k, rows in enumerate((low, high)):
        for p in blocks(len(rows), memory_rows):
            counts[k, 1:] += np.bincount(text[rows[p]], minlength=symbols)
    before = np.cumsum(counts, axis=1)
    del stars, seeds, prefix, turned, allowed
    both = array(len(low) + len(high), low.dtype, memory_rows)
    prefixes = array(len(both) if most is not None else 0, holding(most or 0), memory_rows)
    for p in blocks(len(low), memory_rows):
        own = low[p]
        target = np.arange(p.start, p.stop) + before[1][text[own]]
        both[target] = own
        if most is not None:
            prefixes[target] = low_prefix[p]
    for p in blocks(len(high), memory_rows):
        own = high[::-1][p]
        target = np.arange(p.start, p.stop) + before[0][text[own].astype(np.int64) + 1]
        both[target] = own
        if most is not None:
            # an S suffix has the prefix with the one after it, which is the one before it in the scan
            prefixes[target[1:]] = high_prefix[::-1][p.start : p.stop - 1]
            if p.start:
                prefixes[target[0]] = high_prefix[::-1][p.start - 1]
    if most is None:
        return both
    starts = before[0][:-1] + before[1][:-1]
    some = np.flatnonzero(counts.sum(0)[1:])
    prefixes[starts[some]] = 0
    mixed = np.flatnonzero((counts[0, 1:] > 0) & (counts[1, 1:] > 0))
    turn = starts[mixed] + counts[0, 1:][mixed]
    if len(turn):
        prefixes[turn] = seam(both[turn - 1].astype(np.int64), both[turn].astype(np.int64))
    return both, prefixes


def suffixes(text: np.ndarray, stop: np.ndarray, most: int, memory_rows: int = 1 << 18, levels: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, prefixes): all positions but stops in order of their suffixes, and the common prefix with the one before.

    `text` holds non-negative symbols (as bytes, with stops 0, prefixes are
    read faster); `stop` marks the ends of its strings, the last symbol among
    them. No prefix goes past a stop or `most`. Arrays and queues of more than
    `memory_rows` entries are on disk; recursion ends where there are at most
    NAMES times as many names. `levels`, if given, is told the names of each level and the spills of
    each pair of scans.
    """
    if all(bool(np.all(stop[p])) for p in blocks(len(stop), memory_rows)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols = 1 + max(int(text[p].max()) for p in blocks(len(text), memory_rows))
    s, star = kinds(text, stop, memory_rows)
    stars = star_order(text, stop, s, star, symbols, memory_rows, levels)
    return two_scans(text, stop, s, stars, most, symbols, memory_rows, levels)
