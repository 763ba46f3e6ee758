"""External induced sorting: suffix array and common-prefix values of an integer text, with bounded memory.

The text is a sequence of symbols whose last one is its unique least. Two sweeps do all the work,
one over symbols upwards that derives the L-suffixes from sorted seeds, one downwards that derives
the S-suffixes from the L-suffixes; a sweep takes a tuple (symbol, position, common prefix with the tuple before)
from a priority queue in order and pushes the tuple of the position before. They run first on seeds
known by one symbol, which sorts and names the substrings between leftmost S-positions, then, after
recursion on the string of names, on the sorted seeds.

The queue is monotone: nothing is pushed below what was taken. So it is kept as one append-only
run for each range of symbols with about block tuples; a run goes to disk when the store's
memory is used up, and is loaded, closed under derivation inside the range, and put in order when its turn
comes. Ranges hold whole symbols, so tuples whose successors lie in different ranges share one
symbol only, and the common prefix of others is one more than the least value between their
successors, which stands in the same block. Memory: one block, but at least the most frequent symbol's tuples,
and a few numbers for each distinct symbol.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs

PAGE = 1 << 13


class Store:
    """Arrays that stay in memory up to a number of bytes, then go to files of a folder (a URI)."""

    def __init__(self, folder: str, memory: int = 256 << 20) -> None:
        self.place, base = fs.FileSystem.from_uri(folder)
        self.base, self.memory, self.held, self.made = f"{base}/{uuid.uuid4().hex}", memory, 0, False

    def path(self) -> str:
        if not self.made:
            self.place.create_dir(self.base)
            self.made = True
        return f"{self.base}/{uuid.uuid4().hex}"

    def close(self) -> None:
        if self.made:
            self.place.delete_dir(self.base)
            self.made = False


class Spool:
    """An append-only int64 array in a store."""

    def __init__(self, store: Store) -> None:
        self.store, self.parts, self.ends = store, [], [0]

    def __len__(self) -> int:
        return self.ends[-1]

    def append(self, a: np.ndarray) -> None:
        if not len(a):
            return
        a = np.ascontiguousarray(a, dtype=np.int64)
        if self.store.held + a.nbytes > self.store.memory:
            path = self.store.path()
            with self.store.place.open_output_stream(path) as out:
                out.write(a.tobytes())
            self.parts.append(path)
        else:
            self.store.held += a.nbytes
            self.parts.append(a)
        self.ends.append(self.ends[-1] + len(a))

    def read(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = len(self) if hi is None else hi
        out = []
        for k in range(max(0, int(np.searchsorted(self.ends, lo, side="right")) - 1), len(self.parts)):
            a, b = max(lo, self.ends[k]) - self.ends[k], min(hi, self.ends[k + 1]) - self.ends[k]
            if a >= b:
                break
            part = self.parts[k]
            if isinstance(part, str):
                with self.store.place.open_input_file(part) as f:
                    out.append(np.frombuffer(f.read_at(8 * (b - a), 8 * a), dtype=np.int64))
            else:
                out.append(part[a:b])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.int64)

    def gather(self, at: np.ndarray) -> np.ndarray:
        """Values at any positions; of parts on disk the pages in demand are read, in order."""
        if self.parts and not any(isinstance(p, str) for p in self.parts):
            if len(self.parts) > 1:
                self.parts, self.ends = [np.concatenate(self.parts)], [0, len(self)]
            return self.parts[0][at]
        out = np.empty(len(at), dtype=np.int64)
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        cuts = np.searchsorted(sorted_at, self.ends)
        for k, part in enumerate(self.parts):
            a, b = cuts[k], cuts[k + 1]
            if a == b:
                continue
            local = sorted_at[a:b] - self.ends[k]
            if not isinstance(part, str):
                out[order[a:b]] = part[local]
                continue
            with self.store.place.open_input_file(part) as f:
                page = local // PAGE
                first = np.flatnonzero(np.r_[True, page[1:] - page[:-1] > 1])
                for s, e in zip(first.tolist(), [*first[1:].tolist(), len(local)]):
                    base = int(page[s]) * PAGE
                    block = np.frombuffer(f.read_at(8 * ((int(page[e - 1]) + 1) * PAGE - base), 8 * base), dtype=np.int64)
                    out[order[a + s : a + e]] = block[local[s:e] - base]
        return out

    def drop(self) -> None:
        for part in self.parts:
            if isinstance(part, str):
                self.store.place.delete_file(part)
            else:
                self.store.held -= part.nbytes
        self.parts, self.ends = [], [0]


def _range_min(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of a[lo:hi] for each pair, lo < hi."""
    if not len(lo):
        return np.zeros(0, np.int64)
    level = np.frexp((hi - lo).astype(float))[1] - 1
    out, table = np.empty(len(lo), np.int64), a
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def _dense(order: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rank of each item from the order and where it rises."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.r_[0, np.cumsum(steps)]
    return out


def extend(text: Spool, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at a and b, symbol by symbol; a and b differ and neither runs off the text before they do."""
    out = np.zeros(len(a), dtype=np.int64)
    live, d = np.arange(len(a)), 0
    while len(live):
        same = text.gather(a[live] + d) == text.gather(b[live] + d)
        live = live[same]
        d += 1
        out[live] = d
    return out


def sweep(text: Spool, counts: np.ndarray, seed_pos: Spool, seed_lcp: Spool, sign: int, block: int, store: Store) -> tuple[Spool, Spool, Spool]:
    """All tuples in the order of the sweep (sign 1: symbols upwards): position, common prefix with the tuple before, and whether it is a seed.

    Seeds come in the order of the sweep, with the common prefix with the seed before. For one
    symbol, derived tuples come before seeds. counts has the number of suffixes of each symbol.
    """
    sigma = len(counts)
    sizes = counts if sign > 0 else counts[::-1]
    turn = (lambda s: s) if sign > 0 else (lambda s: sigma - 1 - s)
    # ranges of turned symbols
    total = np.cumsum(sizes)
    bounds, at = [0], 0
    while at < sigma:
        base = total[at - 1] if at else 0
        at = max(at + 1, int(np.searchsorted(total, base + block, side="right")))
        bounds.append(at)
    bound = np.array(bounds)
    queue = [None] * len(bounds)
    out = Spool(store), Spool(store), Spool(store)
    seed_at = 0
    pending_seed: list[np.ndarray] | None = None
    for number in range(len(bounds) - 1):
        low, high = bounds[number], bounds[number + 1]
        # seeds of this range
        parts = []
        while True:
            if pending_seed is None:
                if seed_at >= len(seed_pos):
                    break
                end = min(len(seed_pos), seed_at + block)
                p = seed_pos.read(seed_at, end)
                pending_seed = [p, seed_lcp.read(seed_at, end), turn(text.gather(p))]
                seed_at = end
            cut = int(np.searchsorted(pending_seed[2], high))
            parts.append([c[:cut] for c in pending_seed])
            if cut < len(pending_seed[0]):
                pending_seed = [c[cut:] for c in pending_seed]
                break
            pending_seed = None
        s_pos, s_lcp, s_sym = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(3))
        if queue[number] is not None:
            q_sym, q_pos, q_lcp = (c.read() for c in queue[number])
            for c in queue[number]:
                c.drop()
            queue[number] = None
        else:
            q_sym = q_pos = q_lcp = np.zeros(0, np.int64)
        outside = len(q_pos) + len(s_pos)
        if not outside:
            continue
        # close under derivation inside the range
        sym, pos, lcp = [np.concatenate([q_sym, s_sym])], [np.concatenate([q_pos, s_pos])], np.concatenate([q_lcp, s_lcp])
        kind = [np.concatenate([np.zeros(len(q_pos), np.int64), np.full(len(s_pos), 2)])]
        parent, target = [np.arange(outside)], []
        front_sym, front_pos, front_kind, base = sym[0], pos[0], kind[0], 0
        while len(front_pos):
            t = np.full(len(front_pos), -1, dtype=np.int64)
            some = np.flatnonzero(front_pos > 0)
            t[some] = turn(text.gather(front_pos[some] - 1))
            goes = np.where(front_kind == 2, t > front_sym, t >= front_sym) & (front_pos > 0)
            t[~goes] = -1
            inside = np.flatnonzero(goes & (t < high))
            target.append(np.where(t >= high, t, -1))
            parent.append(base + inside)
            base += len(front_pos)
            front_sym, front_pos, front_kind = t[inside], front_pos[inside] - 1, np.ones(len(inside), np.int64)
            sym.append(front_sym)
            pos.append(front_pos)
            kind.append(front_kind)
        sym, pos, kind, parent, target = (np.concatenate(x) for x in (sym, pos, kind, parent, target))
        n = len(sym)
        # order: by symbol; derived before the range, derived in it by the order of successors, seeds. Chains of
        # successors inside the range are compared by doubling: level t knows the order by the first 2^t of a chain
        came = np.arange(n) < outside
        order = np.argsort(((sym - low) * 3 + kind) * (n + 1) + np.where(came, np.arange(1, n + 1), 0))
        first = ((sym - low) * 3 + kind)[order]
        rank = _dense(order, (first[1:] != first[:-1]) | came[order[1:]])
        ancestor = np.where(came, np.arange(n), parent)
        levels = [(rank, ancestor)]
        while rank[order[-1]] + 1 < n:
            both = rank * n + rank[ancestor]
            order = np.argsort(both)
            rank = _dense(order, np.diff(both[order]) > 0)
            ancestor = ancestor[ancestor]
            levels.append((rank, ancestor))
        full = np.zeros(n, dtype=np.int64)
        at = np.flatnonzero(sym[order[1:]] == sym[order[:-1]]) + 1
        a, b = order[at - 1], order[at]
        value = np.zeros(len(at), dtype=np.int64)
        for t in range(len(levels) - 1, -1, -1):
            rank, ancestor = levels[t]
            same = rank[a] == rank[b]
            a, b = np.where(same, ancestor[a], a), np.where(same, ancestor[b], b)
            value += same.astype(np.int64) << t
        # where the chains part: tuples of one kind that came from outside have common prefixes; tuples of which one
        # came and one was derived here have one symbol in common; a seed and another are compared symbol by symbol
        alike = sym[a] == sym[b]
        seeds = np.flatnonzero(alike & (kind[a] != kind[b]) & ((kind[a] == 2) | (kind[b] == 2)))
        value[seeds] += extend(text, pos[a[seeds]], pos[b[seeds]])
        value[alike & (kind[a] != kind[b]) & (kind[a] < 2) & (kind[b] < 2)] += 1
        peers = np.flatnonzero(alike & (kind[a] == kind[b]))
        by = np.argsort((sym[:outside] * 3 + kind[:outside]) * (outside + 1) + np.arange(outside))
        place = np.empty(outside, dtype=np.int64)
        place[by] = np.arange(outside)
        value[peers] += _range_min(lcp[by], place[a[peers]] + 1, place[b[peers]] + 1)
        full[at] = value
        sym, pos, kind, target = sym[order], pos[order], kind[order], target[order]
        # push what goes beyond the range
        far = np.flatnonzero(target >= 0)
        if len(far):
            by = far[np.argsort(target[far], kind="stable")]
            t = target[by]
            value = np.zeros(len(by), dtype=np.int64)
            follow = np.flatnonzero(t[1:] == t[:-1]) + 1
            value[follow] = 1
            near = follow[sym[by[follow]] == sym[by[follow - 1]]]
            value[near] = 1 + _range_min(full, by[near - 1] + 1, by[near] + 1)
            value[np.r_[True, t[1:] != t[:-1]]] = 1  # its neighbour's successor lies in another range
            to = np.searchsorted(bound, t, side="right") - 1
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)]):
                k = int(to[a])
                if queue[k] is None:
                    queue[k] = (Spool(store), Spool(store), Spool(store))
                for c, v in zip(queue[k], (t[a:b], pos[by[a:b]] - 1, value[a:b])):
                    c.append(v)
        for c, v in zip(out, (pos, full, kind == 2)):
            c.append(v)
    return out


def _chunks(n: int, block: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + block)) for a in range(0, n, block)]


def _thin(pos: Spool, lcp: Spool, keep, block: int, store: Store) -> tuple[Spool, Spool]:
    """The tuples that keep(positions, lo, hi) chooses, with the common prefix with the chosen one before: the least value on the way."""
    out, held = (Spool(store), Spool(store)), np.iinfo(np.int64).max
    for a, b in _chunks(len(pos), block):
        p, v = pos.read(a, b), lcp.read(a, b).copy()
        v[0] = min(int(v[0]), held)
        at = np.flatnonzero(keep(p, a, b))
        rest = v
        if len(at):
            out[0].append(p[at])
            out[1].append(np.minimum.reduceat(v[: at[-1] + 1], np.r_[0, at[:-1] + 1]))
            rest = v[at[-1] + 1 :]
        held = int(rest.min()) if len(rest) else np.iinfo(np.int64).max
    return out


def _turned(pos: Spool, lcp: Spool, block: int, store: Store) -> tuple[Spool, Spool]:
    """The tuples in the opposite order."""
    out, n = (Spool(store), Spool(store)), len(pos)
    for a, b in reversed(_chunks(n, block)):
        v = lcp.read(a + 1, min(n, b + 1))
        if b == n:
            v = np.append(v, 0)
        out[0].append(pos.read(a, b)[::-1])
        out[1].append(v[::-1])
    return out


def _drop(*spools: Spool) -> None:
    for s in spools:
        s.drop()


def _derive(text: Spool, counts: np.ndarray, seed_pos: Spool, seed_lcp: Spool, block: int, store: Store) -> tuple[Spool, Spool]:
    """Both sweeps: all suffixes but the last, in ascending order, with common prefixes."""
    up_pos, up_lcp, up_seed = sweep(text, counts, seed_pos, seed_lcp, 1, block, store)
    left = _thin(up_pos, up_lcp, lambda p, a, b: up_seed.read(a, b) == 0, block, store)
    _drop(up_pos, up_lcp, up_seed)
    seeds = _turned(*left, block, store)
    _drop(*left)
    down_pos, down_lcp, down_seed = sweep(text, counts, *seeds, -1, block, store)
    _drop(*seeds, down_seed)
    out = _turned(down_pos, down_lcp, block, store)
    _drop(down_pos, down_lcp)
    return out


def _leftmost(text: Spool, block: int, store: Store) -> Spool:
    """Positions of S-suffixes whose left neighbour is an L-suffix, ascending."""
    n, found = len(text), Spool(store)
    after, first_s = True, False
    for a, b in reversed(_chunks(n, block)):
        t = text.read(a, min(n, b + 1))
        d = np.sign(t[:-1] - t[1:]) if b < n else np.append(np.sign(t[:-1] - t[1:]), -1)
        # equal neighbours take the type of the next unequal one
        at = np.where(d != 0, np.arange(len(d)), len(d))
        at = np.minimum.accumulate(at[::-1])[::-1]
        s = np.append(d < 0, after)[at]
        here = np.flatnonzero(s[1:] & ~s[:-1]) + 1 + a
        if b < n and first_s and not s[-1]:
            here = np.append(here, b)
        found.append(here[::-1])
        after = first_s = bool(s[0])
    out = Spool(store)
    for a, b in reversed(_chunks(len(found), block)):
        out.append(found.read(a, b)[::-1])
    found.drop()
    return out


def _scatter(keys: Spool, values: Spool, size: int, block: int, store: Store, default: int = -1) -> Spool:
    """An array of size with values at keys."""
    runs = [(Spool(store), Spool(store)) for _ in range(-(-size // block))]
    for a, b in _chunks(len(keys), block):
        k, v = keys.read(a, b), values.read(a, b)
        to = k // block
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(len(runs) + 1))
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            part = order[cuts[r] : cuts[r + 1]]
            runs[r][0].append(k[part])
            runs[r][1].append(v[part])
    out = Spool(store)
    for r, (k, v) in enumerate(runs):
        dense = np.full(min(block, size - r * block), default, dtype=np.int64)
        dense[k.read() - r * block] = v.read()
        out.append(dense)
        _drop(k, v)
    return out


def _by_symbol(text: Spool, pos: Spool, counts: np.ndarray, block: int, store: Store) -> tuple[Spool, Spool]:
    """Positions in the order of their symbols, with common prefix 1 for the same symbol as before, else 0."""
    total = np.cumsum(counts) // block
    runs: dict[int, tuple[Spool, Spool]] = {}
    for a, b in _chunks(len(pos), block):
        p = pos.read(a, b)
        t = text.gather(p)
        to = total[t]
        order = np.argsort(to, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(to[order]) > 0])
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(p)]):
            part = order[lo:hi]
            run = runs.setdefault(int(to[part[0]]), (Spool(store), Spool(store)))
            run[0].append(p[part])
            run[1].append(t[part])
    out = Spool(store), Spool(store)
    for r in sorted(runs):
        p, t = (c.read() for c in runs[r])
        order = np.argsort(t, kind="stable")
        out[0].append(p[order])
        out[1].append(np.r_[0, (np.diff(t[order]) == 0).astype(np.int64)])
        _drop(*runs[r])
    return out


def suffix_array(text: Spool, block: int, store: Store) -> tuple[Spool, Spool]:
    """(positions, common prefixes) of all suffixes in ascending order; text ends with its unique least symbol 0."""
    n = len(text)
    counts = np.zeros(0, dtype=np.int64)
    for a, b in _chunks(n, block):
        c = np.bincount(text.read(a, b), minlength=len(counts))
        c[: len(counts)] += counts
        counts = c
    lms = _leftmost(text, block, store)
    if n == 1:
        lms.append(np.array([0]))
    m = len(lms)
    half, number = Spool(store), Spool(store)  # leftmost positions are two apart at least
    for a, b in _chunks(m, block):
        p = lms.read(a, b)
        half.append(p >> 1)
        number.append(np.arange(a, b) << 1 | (p & 1))
    slot = _scatter(half, number, (n + 1) // 2, block, store)
    _drop(half, number)

    def named(p: np.ndarray) -> np.ndarray:
        v = slot.gather(p >> 1)
        return (v >= 0) & ((v & 1) == (p & 1))

    # first pass: order and names of the substrings between leftmost positions
    seeds = _by_symbol(text, lms, counts, block, store)
    rough = _derive(text, counts, *seeds, block, store)
    _drop(*seeds)
    pos, lcp = _thin(*rough, lambda p, a, b: named(p), block, store)
    _drop(*rough)
    index, name = Spool(store), Spool(store)
    index.append(np.array([m - 1]))
    name.append(np.array([0]))
    last, before = 0, 1
    for a, b in _chunks(len(pos), block):
        p = pos.read(a, b)
        i = slot.gather(p >> 1) >> 1
        length = lms.gather(i + 1) - p + 1
        same = (lcp.read(a, b) >= length) & (length == np.r_[before, length[:-1]])
        names = last + np.cumsum(~same)
        index.append(i)
        name.append(names)
        last, before = int(names[-1]), int(length[-1])
    slot.drop()
    # sorted seeds, with their whole common prefixes
    seeds = Spool(store), Spool(store)
    if last + 1 == m:
        seeds[0].append(np.array([n - 1]))
        seeds[1].append(np.array([0]))
        for a, b in _chunks(len(pos), block):
            p, d = pos.read(a, b), lcp.read(a, b)
            if a:
                q, first = pos.read(a - 1, b - 1), 0
            else:
                q, first = np.r_[n - 1, p[:-1]], 1
            v = np.zeros(len(p), dtype=np.int64)
            v[first:] = d[first:] + extend(text, p[first:] + d[first:], q[first:] + d[first:])
            seeds[0].append(p)
            seeds[1].append(v)
    else:
        reduced = _scatter(index, name, m, block, store)
        r_pos, r_lcp = suffix_array(reduced, block, store)
        reduced.drop()
        was = np.zeros(0, dtype=np.int64)
        for a, b in _chunks(m, block):
            r, l = r_pos.read(a, b), r_lcp.read(a, b)
            p = lms.gather(r)
            d = lms.gather(r + l) - p
            q = np.r_[was, p[:-1]]
            first = len(p) - len(q)
            v = np.zeros(len(p), dtype=np.int64)
            first = 1 if first else 0
            q = q if not first else np.r_[0, q]
            v[first:] = d[first:] + extend(text, p[first:] + d[first:], q[first:] + d[first:])
            seeds[0].append(p)
            seeds[1].append(v)
            was = p[-1:]
        _drop(r_pos, r_lcp)
    _drop(pos, lcp, index, name, lms)
    rest = _derive(text, counts, *seeds, block, store)
    _drop(*seeds)
    out = Spool(store), Spool(store)
    out[0].append(np.array([n - 1]))
    out[1].append(np.array([0]))
    for a, b in _chunks(len(rest[0]), block):
        for c, x in zip(out, rest):
            c.append(x.read(a, b))
    _drop(*rest)
    return out
