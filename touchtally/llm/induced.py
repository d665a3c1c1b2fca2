"""Suffix and common-prefix arrays by external induced sorting.

Suffixes that begin a rising stretch after a fall (the leftmost smaller ones) are sorted by
recursion on the text of their names; all others are induced from them in two passes, by
rank upwards and downwards. A pass takes suffix tuples (position, common prefix with the
tuple before) from a priority queue and puts the suffix one place to the left back in. Ranks only
grow during a pass, so the queue is one first-in-first-out file per first symbol, and
tuples move in blocks. Blocks above a memory bound lie on disk. The common prefix of two
induced suffixes is one more than the smallest one between their parents; a running
minimum per symbol carries it from block to block.

Symbols are small integers, 0 the separator. Common prefixes are counted up to ``cap``.
"""

from __future__ import annotations

import tempfile

import numpy as np

QUEUE_BYTES = 8 << 20
# A reduced text of up to this many names is sorted in memory.
IN_MEMORY = 1 << 21
BLOCK = 1 << 16


class SymbolQueue:
    """A priority queue of (position, common prefix) blocks keyed by symbol; blocks come back in the order they went in."""

    def __init__(self, memory: int = QUEUE_BYTES) -> None:
        self.blocks: dict[int, list] = {}
        self.memory, self.held = memory, 0
        self.file = None

    def put(self, symbol: int, position: np.ndarray, common: np.ndarray) -> None:
        block: tuple = (position, common)
        if self.held + position.nbytes + common.nbytes > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # gone when closed, also when the task dies
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(position.tobytes())
            self.file.write(common.tobytes())
            block = (at, len(position))
        else:
            self.held += position.nbytes + common.nbytes
        self.blocks.setdefault(symbol, []).append(block)

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All blocks of a symbol, in order."""
        blocks = self.blocks.pop(symbol, None)
        if not blocks:
            return None
        out = []
        for a, b in blocks:
            if isinstance(a, int):
                self.file.seek(a)
                data = self.file.read(6 * b)
                out.append((np.frombuffer(data[: 4 * b], np.int32), np.frombuffer(data[4 * b :], np.uint16)))
            else:
                self.held -= a.nbytes + b.nbytes
                out.append((a, b))
        if len(out) == 1:
            return out[0]
        return np.concatenate([p for p, _ in out]), np.concatenate([c for _, c in out])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _RangeMinimum:
    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum over [lo, hi]; hi >= lo."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=self.levels[0].dtype)
        for k in range(int(level.max(initial=0)) + 1):
            at = np.flatnonzero(level == k)
            if len(at):
                table = self.levels[k]
                out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
        return out


def smaller_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one is not."""
    n = len(text)
    rising = np.zeros(n, dtype=bool)
    if n < 2:
        return rising
    # Positions are four bytes here as in the queues.
    nearest = np.where(text[1:] != text[:-1], np.arange(n - 1, dtype=np.int32), np.int32(n))
    np.minimum.accumulate(nearest[::-1], out=nearest[::-1])  # the next place where neighbours differ decides
    up = np.append(text[1:] > text[:-1], False)
    rising[:-1] = up[np.minimum(nearest, n - 1)]
    return rising


def _names(text: np.ndarray, rising: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Ranks of the stretches from each of ``begin`` to the next, equal for equal stretches."""
    n = len(text)
    end = np.minimum(np.append(begin[1:], n - 1), n - 1)
    size = end - begin + 1
    letters = (text.astype(np.uint32) << np.uint32(1)) | rising  # names are below 2**31
    bits = max(int(letters.max(initial=0)).bit_length(), 1)
    per = max(1, 63 // bits)
    rank = np.zeros(len(begin), dtype=np.int64)
    active, done = np.arange(len(begin)), 0
    while len(active):
        word = np.zeros(len(active), dtype=np.uint64)
        for k in range(per):
            here = begin[active] + done + k
            inside = done + k < size[active]
            word = (word << np.uint64(bits)) | np.where(inside, letters[np.minimum(here, n - 1)], 0).astype(np.uint64)
        order = np.lexsort((word, rank[active]))
        r, w = rank[active][order], word[order]
        group = np.ones(len(order), dtype=bool)
        group[1:] = r[1:] != r[:-1]
        new = group.copy()
        new[1:] |= w[1:] != w[:-1]
        index = np.arange(len(order))
        first_of_group = np.maximum.accumulate(np.where(group, index, 0))
        first_of_new = np.maximum.accumulate(np.where(new, index, 0))
        rank[active[order]] = r + (first_of_new - first_of_group)
        done += per
        active = active[size[active] > done]
    return rank


def _doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a short text, by doubling the compared length."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, dtype=np.int64)

    def ranked(order: np.ndarray, differs: np.ndarray) -> None:
        rank[order] = np.maximum.accumulate(np.where(differs, np.arange(n), 0))

    differs = np.ones(n, dtype=bool)
    differs[1:] = names[order[1:]] != names[order[:-1]]
    ranked(order, differs)
    width = 1
    # Only suffixes whose rank is shared move; they move inside their group.
    at = np.flatnonzero(~differs | np.append(~differs[1:], False))
    while len(at) and width < n:
        members = order[at]
        follow = np.where(members + width < n, rank[np.minimum(members + width, n - 1)], -1)
        inner = np.lexsort((follow, rank[members]))
        members, follow = members[inner], follow[inner]
        order[at] = members
        own = rank[members]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])
        rank[members] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~new | np.append(~new[1:], False)]
        width *= 2
    return order


class Prefixes:
    """Common prefixes of pairs of suffixes, compared several packed symbols at a time, up to ``cap``."""

    def __init__(self, text: np.ndarray, cap: int) -> None:
        self.n, self.cap = len(text), cap
        self.bits = max(int(text.max(initial=0)).bit_length(), 1)
        self.per = max(1, 63 // self.bits)
        self.packed = text.astype(np.uint64)
        for k in range(1, min(self.per, self.n)):
            # A piece at a time, so that there is no second copy.
            for lo in range(0, self.n - k, BLOCK):
                hi = min(lo + BLOCK, self.n - k)
                self.packed[lo:hi] |= text[lo + k : hi + k].astype(np.uint64) << np.uint64(k * self.bits)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.astype(np.int64), b.astype(np.int64)
        # Past the end nothing is common, whatever the padding says.
        limit = np.minimum(self.n - np.maximum(a, b), self.cap)
        out = limit.copy()
        active, done = np.arange(len(a)), 0
        while len(active):
            differ = self.packed[a[active] + done] ^ self.packed[b[active] + done]
            found = differ != 0
            low = differ[found]
            low &= np.uint64(0) - low
            equal = (np.frexp(low.astype(np.float64))[1] - 1) // self.bits
            hit = active[found]
            out[hit] = np.minimum(limit[hit], done + equal)
            done += self.per
            active = active[~found]
            active = active[limit[active] > done]
        return out.astype(np.uint16)


def _pass(text, rising, upwards: bool, seeds, cap, memory, want_common, prefixes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """One induction. ``seeds`` gives, by symbol, the sorted tuples that the pass starts from.

    Returns the induced tuples by symbol in rank order (upwards), or reversed (downwards).
    """
    symbols = int(text.max(initial=0)) + 1
    queue = SymbolQueue(memory)
    none = cap
    carry = np.full(symbols, none, dtype=np.uint16)
    done: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def induce(position: np.ndarray, common: np.ndarray) -> None:
        for lo in range(0, len(position), BLOCK):
            _induce_block(position[lo : lo + BLOCK], common[lo : lo + BLOCK])

    def _induce_block(position: np.ndarray, common: np.ndarray) -> None:
        left = position - 1
        ok = position > 0
        ok &= rising[left] != upwards
        at = np.flatnonzero(ok)
        if want_common:
            minimum = _RangeMinimum(common)
            whole = common.min()
        if not len(at):
            if want_common:
                np.minimum(carry, whole, out=carry)
            return
        target = text[left[at]]
        order = np.argsort(target, kind="stable")
        at, target = at[order], target[order]
        head = np.ones(len(at), dtype=bool)
        head[1:] = target[1:] != target[:-1]
        if want_common:
            before = np.where(head, -1, np.concatenate([[0], at[:-1]]))
            value = minimum(before + 1, at)
            value[head] = np.minimum(value[head], carry[target[head]])
            value = np.minimum(value + np.uint16(1), np.uint16(cap))
            tail = np.append(head[1:], True)
            last, of = at[tail], target[tail]
            np.minimum(carry, whole, out=carry)
            after = np.full(len(last), none, dtype=np.uint16)
            more = last < len(common) - 1
            if more.any():
                after[more] = minimum(last[more] + 1, np.full(more.sum(), len(common) - 1))
            carry[of] = after
        else:
            value = np.zeros(len(at), dtype=np.uint16)
        starts = np.flatnonzero(head)
        place = left[at].astype(np.int32)
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(at)).tolist()):
            queue.put(int(target[a]), place[a:b], value[a:b])

    for symbol in range(symbols) if upwards else range(symbols - 1, -1, -1):
        found = []
        while (block := queue.take(symbol)) is not None:
            position, common = block
            if not found:
                common = common.copy()
                common[0] = 0  # the bucket's first has nothing in common with the bucket before
            found.append((position, common))
            induce(position, common)
        if found:
            done[symbol] = (np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found]))
        own = seeds(symbol)
        if own is not None:
            position, common = own
            common = common.copy()
            common[0] = 0
            if found and want_common:
                common[0] = prefixes(found[-1][0][-1:], position[:1])[0]
            induce(position, common)
    queue.close()
    return done


def suffix_array(text: np.ndarray, cap: int = 400, memory: int = QUEUE_BYTES, want_common: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order, and each one's common prefix with the one before, up to ``cap``."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.uint16)
    rising = smaller_types(text)
    begin = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    names = _names(text, rising, begin)
    if len(begin) <= IN_MEMORY:
        order = _doubling(names)
    else:
        dense = np.searchsorted(np.unique(names), names) + 1
        order = suffix_array(dense, cap, memory, False)[0].astype(np.int64)
    seeds = begin[order].astype(np.int32)
    prefixes = Prefixes(text, cap) if want_common else None
    common = np.zeros(len(seeds), dtype=np.uint16)
    if want_common and len(seeds) > 1:
        common[1:] = prefixes(seeds[:-1], seeds[1:])
    first = text[seeds]
    symbols = int(text.max()) + 1
    cuts = np.searchsorted(first, np.arange(symbols + 1))

    def of_seeds(symbol: int):
        a, b = int(cuts[symbol]), int(cuts[symbol + 1])
        return (seeds[a:b], common[a:b]) if b > a else None

    # The last suffix is the smallest of its symbol; it enters as a falling one before all others.
    falling = _pass_with_last(text, rising, of_seeds, cap, memory, want_common, prefixes)

    def of_falling(symbol: int):
        block = falling.get(symbol)
        if block is None:
            return None
        position, shared = block
        down = np.zeros(len(shared), dtype=np.uint16)
        down[1:] = shared[1:][::-1]
        return position[::-1], down

    rest = _pass(text, rising, False, of_falling, cap, memory, want_common, prefixes)
    out, shares = [], []
    for symbol in range(symbols):
        block = falling.get(symbol)
        if block is not None:
            out.append(block[0])
            shares.append(block[1])
        up = rest.get(symbol)
        if up is not None:
            position, down = up
            shared = np.zeros(len(down), dtype=np.uint16)
            shared[1:] = down[1:][::-1]
            position = position[::-1]
            if block is not None and want_common:
                shared[0] = prefixes(block[0][-1:], position[:1])[0]
            out.append(position)
            shares.append(shared)
    return np.concatenate(out), np.concatenate(shares)


def _pass_with_last(text, rising, of_seeds, cap, memory, want_common, prefixes):
    """The upward pass; the text ends as if a symbol below all others followed, which puts the last suffix first in its bucket."""
    longer = np.append(text + 1, 0).astype(text.dtype if text.max(initial=0) + 1 < np.iinfo(text.dtype).max else np.int64)
    types = np.append(rising, True)

    def seeds(symbol: int):
        if symbol == 0:
            return np.array([len(text)], dtype=np.int32), np.zeros(1, dtype=np.uint16)
        return of_seeds(symbol - 1)

    found = _pass(longer, types, True, seeds, cap, memory, want_common, prefixes)
    return {symbol - 1: block for symbol, block in found.items()}
