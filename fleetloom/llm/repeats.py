"""Which windows of a document also start in a document with a smaller id.

Shared by the two substring operators. Texts are arrays of 64-bit symbols (hashed words), or of bytes.
Each window of `length` symbols chooses the k-gram in it with the least hash; equal windows choose
alike, whatever surrounds them. A maximal run of window starts that choose one k-gram occurrence is a
stretch: the k-gram with what its windows reach to the left and right, at most 2 * length - k symbols.

1. Blocks send the hashes of their chosen k-grams, packed; those found in two documents are repeated.
2. Blocks send their distinct stretches around repeated k-grams, each with what it holds and its
   smallest doc_id, to the hash partition of the k-gram. There stretches are compared by what they
   hold, equal windows of different stretches meet, and the smallest doc_id of each window is known.
3. Blocks hear that smallest doc_id for those of their windows where it is smaller than an own one.

Nothing is expanded into pairs, and no window that could repeat is left out: a window equal to one in
another document has its k-gram in both, so both stretches reach the same hash partition. Hashes only
say where to meet and, within one block, which stretches are equal (64 bits, some 2 ** 20 a block).

Each block has a pack for each hash partition, so packs grow with the product of the two and cost more
than their content once both are many. Blocks and partitions are therefore large, and worked on in
pieces: whole documents of a block, whole k-grams of a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Block, met, pack, packs, parts_for, returned, unpack

_BASE = 0x9E3779B97F4A7C15
LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_powers: dict[str, np.ndarray] = {}
#: Bytes as symbols.
_BYTE = np.random.Generator(np.random.PCG64(10)).integers(1, 1 << 63, 256, np.uint64)
#: Symbols of a block, and bytes of a hash partition, that are worked on at once.
PIECE_SYMBOLS, PIECE_BYTES = 1 << 20, 1 << 20


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the base, or of its inverse, modulo 2 ** 64."""
    held = _powers.get(kind)
    if held is None or len(held) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        held = _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """x with its bits mixed; in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of any stretch of a symbol array, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(symbols * _power("up", self.n), out=self.sums[1:])

    def every(self, k: int) -> np.ndarray:
        """The hash of the k symbols at each place."""
        m = max(0, self.n - k + 1)
        out = self.sums[k:] - self.sums[:m] if m else np.zeros(0, np.uint64)
        out *= _power("down", m)
        return mixed(out)

    def some(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * _power("down", self.n + 1)[starts])


def least_in_window(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


@dataclass
class Stretches:
    """first, last: window starts. place: of the chosen k-gram. anchor: its hash. key: hash of the whole stretch."""

    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    doc: np.ndarray


def stretches(symbols: np.ndarray, starts: np.ndarray, length: int, k: int) -> Stretches:
    """All stretches of documents that lie one after the other; starts: their offsets and the end."""
    cuts = [0]
    for i in range(1, len(starts) - 1):
        if starts[i + 1] - starts[cuts[-1]] > PIECE_SYMBOLS:
            cuts.append(i)
    made = []
    for a, b in zip(cuts, cuts[1:] + [len(starts) - 1], strict=True):
        at = int(starts[a])
        piece = symbols[at : starts[b]]
        found = _stretches(_BYTE[piece] if piece.dtype == np.uint8 else piece, starts[a : b + 1] - at, length, k)
        made.append((found.first + at, found.last + at, found.place + at, found.anchor, found.key, found.doc + a))
    return Stretches(*(np.concatenate(x) for x in zip(*made, strict=True)))


def _stretches(symbols: np.ndarray, starts: np.ndarray, length: int, k: int) -> Stretches:
    rolling = Rolling(symbols)
    none = np.zeros(0, np.int64)
    if len(symbols) < length:
        return Stretches(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    hashes = rolling.every(k)
    places = np.arange(len(hashes), dtype=np.uint64)
    chosen = least_in_window((hashes & _HIGH) | (LOW - places), length - k + 1)  # of equal ones the last
    step = np.zeros(len(symbols) + 1, np.int32)
    np.add.at(step, starts[:-1], 1)
    np.add.at(step, np.maximum(starts[:-1], starts[1:] - length + 1), -1)
    inside = np.cumsum(step)[: len(chosen)] > 0
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (inside[1:] != inside[:-1])
    begins = np.flatnonzero(new)
    lasts = np.append(begins[1:], len(chosen)) - 1
    good = inside[begins]
    first, last = begins[good], lasts[good]
    place = (LOW - (chosen[first] & LOW)).astype(np.int64)
    key = rolling.some(first, last + length)
    return Stretches(first, last, place, hashes[place], key, np.searchsorted(starts, first, "right") - 1)


def by_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition in the upper half, 32 bits to tell hashes apart there in the lower one."""
    return ((hashes >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32) | (hashes & LOW)


def slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted keys as by_part() makes them."""
    parts = (keys >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(keys)]]) if len(keys) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(parts[a]), int(a), int(b)


def _grams(found: Stretches, ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct chosen k-grams of a block as by_part() keys, and which of them two of its documents have."""
    keys = by_part(found.anchor, parts)
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], ids[found.doc[order]]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(begins):
        return keys, np.zeros(0, bool)
    return keys[begins], np.minimum.reduceat(docs, begins) != np.maximum.reduceat(docs, begins)


def smallest_starts(
    blocks: DataFrame,
    read: Callable[[Block], tuple[np.ndarray, np.ndarray]],
    content: Callable[[Stretches, np.ndarray, Block], tuple[np.ndarray, ...]],
    meet: Callable[..., np.ndarray],
    length: int,
    k: int,
    part_bytes: int,
) -> DataFrame:
    """Answers to blocks: (key, from, to, least), window starts of the stretch `key` and their smallest doc_id.

    read(block): symbols, offsets. content(stretches, chosen, block): the bytes of those stretches one
    after the other, how many each has, and further numbers of each, for meet(numbers of windows,
    phrase of each occurrence, its doc_id, bytes, sizes, further numbers), which returns the smallest
    doc_id of each window of each distinct stretch ("phrase").
    """
    parts = parts_for(blocks, part_bytes)

    def tell(number: int, block: Block) -> Iterator[tuple[int, bytes]]:
        symbols, starts = read(block)
        keys, twice = _grams(stretches(symbols, starts, length, k), block.ids, parts)
        for part, a, b in slices(keys):
            yield part, pack((keys[a:b] & LOW).astype(np.uint32), np.packbits(twice[a:b]))

    def shared(numbers: list[int], sent: list[bytes]) -> Iterator[tuple[int, bytes]]:
        got = [unpack(x) for x in sent]
        sizes = [len(g[0]) for g in got]
        keys = np.concatenate([g[0] for g in got])
        flags = np.concatenate([np.unpackbits(g[1], count=len(g[0])) for g in got]).astype(bool)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        # A k-gram that one block alone has, in two of its documents, is repeated as well.
        twice |= flags
        at = 0
        for number, size in zip(numbers, sizes, strict=True):
            yield number, pack(np.packbits(twice[at : at + size]))
            at += size

    def send(number: int, block: Block, told: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        symbols, starts = read(block)
        found = stretches(symbols, starts, length, k)
        keys, _ = _grams(found, block.ids, parts)
        mask = np.zeros(len(keys), bool)
        for part, a, b in slices(keys):
            mask[a:b] = np.unpackbits(unpack(told[part])[0], count=b - a)
        mine = by_part(found.anchor, parts)
        wanted = np.flatnonzero(mask[np.searchsorted(keys, mine)]) if len(keys) else np.zeros(0, np.int64)
        # Of equal stretches in the block one goes, with the smallest and largest doc_id.
        order = wanted[np.lexsort((found.key[wanted], mine[wanted]))]
        if not len(order):
            return
        k_, m_ = found.key[order], mine[order]
        begins = np.flatnonzero(np.concatenate([[True], (k_[1:] != k_[:-1]) | (m_[1:] != m_[:-1])]))
        docs = block.ids[found.doc[order]]
        low, high = np.minimum.reduceat(docs, begins), np.maximum.reduceat(docs, begins)
        one = order[begins]
        for part, a, b in slices(mine[one]):
            chosen = one[a:b]
            windows = (found.last[chosen] - found.first[chosen] + 1).astype(np.uint16)
            yield part, pack(found.key[chosen], (found.anchor[chosen] & LOW).astype(np.uint32), low[a:b], high[a:b], windows, *content(found, chosen, block))

    def resolve(numbers: list[int], sent: list[bytes]) -> Iterator[tuple[int, bytes]]:
        got = [unpack(x) for x in sent]
        key, anchor, low, high, windows = (np.concatenate([g[i] for g in got]) for i in range(5))
        owner = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        flat, sizes, *more = (np.concatenate([g[i] for g in got]) for i in range(5, len(got[0])))
        del got
        sizes = sizes.astype(np.int64)
        at = np.cumsum(sizes) - sizes
        made = []
        for held in gram_pieces(anchor, sizes, PIECE_BYTES):
            row, *told = _resolved(key[held], anchor[held], low[held], high[held], windows[held].astype(np.int64), flat[_ranges(at[held], sizes[held])], sizes[held], [m[held] for m in more], meet)
            made.append((owner[held][row], key[held][row], *told))
        whose, *told = (np.concatenate(x) for x in zip(*made, strict=True))
        order = np.argsort(whose, kind="stable")
        ends = np.searchsorted(whose[order], np.arange(len(numbers) + 1))
        for number, a, b in zip(numbers, ends[:-1], ends[1:], strict=True):
            if a < b:
                yield number, pack(*(x[order[a:b]] for x in told))

    repeated = met(packs(blocks, tell), shared)

    def send_rows(number: int, block: Block, told: dict[int, bytes]) -> pa.Table:
        made = list(send(number, block, told))
        return pa.table({"part": pa.array([p for p, _ in made], pa.int32()), "block": pa.array([number] * len(made), pa.int64()), "pack": pa.array([x for _, x in made], pa.binary())})

    sent = returned(blocks, repeated, send_rows, "part int, block long, pack binary")
    return met(sent, resolve)


def gram_pieces(anchor: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The stretches of whole k-grams, most bytes at a time or one k-gram that alone has more; in a piece as they came."""
    order = np.argsort(anchor, kind="stable")
    ranked = anchor[order]
    ends = np.append(np.flatnonzero(ranked[1:] != ranked[:-1]) + 1, len(order))
    held = np.cumsum(sizes[order])[ends - 1]
    a = done = 0
    while a < len(order):
        i = np.searchsorted(held, done + most, "right")
        i = max(int(i) - 1, int(np.searchsorted(ends, a, "right")))
        yield np.sort(order[a : ends[i]])
        a, done = int(ends[i]), int(held[i])


def _resolved(key: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, windows: np.ndarray, flat: np.ndarray, sizes: np.ndarray, more: list[np.ndarray], meet: Callable[..., np.ndarray]) -> tuple[np.ndarray, ...]:
    """(stretch, from, to, least): runs of windows of stretches that a smaller doc_id than their largest one has."""
    at = np.cumsum(sizes) - sizes
    one, which = distinct(key, flat, at, sizes)
    # Where a k-gram has one stretch only, its windows have no others to meet. Half a hash will do: k-grams that it mixes up are compared in vain.
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, which, low)
    _, group, count = np.unique(anchor[one], return_inverse=True, return_counts=True)
    crowd = np.flatnonzero(count[group] > 1)
    size = windows[one]
    ends = np.cumsum(size)
    smallest = np.repeat(least, size)
    if len(crowd):
        rows = one[crowd]
        number = np.full(len(one), -1)
        number[crowd] = np.arange(len(crowd))
        occur = np.flatnonzero(number[which] >= 0)
        smallest[_ranges(ends[crowd] - size[crowd], size[crowd])] = meet(size[crowd], number[which[occur]], low[occur], flat[_ranges(at[rows], sizes[rows])], sizes[rows], *(m[rows] for m in more))
    # Runs of windows with one smallest doc_id.
    new = np.zeros(len(smallest), bool)
    new[ends - size] = True
    new[1:] |= smallest[1:] != smallest[:-1]
    runs = np.flatnonzero(new)
    run_end = np.append(runs[1:], len(smallest))
    stretch = np.searchsorted(ends, runs, "right")
    begin = (ends - size)[stretch]
    n_runs = np.bincount(stretch, minlength=len(one))
    run_at = np.cumsum(n_runs) - n_runs
    picked = _ranges(run_at[which], n_runs[which])
    row = np.repeat(np.arange(len(which)), n_runs[which])
    real = smallest[runs[picked]] < high[row]
    r, row = picked[real], row[real]
    return row, (runs[r] - begin[r]).astype(np.uint16), (run_end[r] - begin[r]).astype(np.uint16), smallest[runs[r]]


def distinct(key: np.ndarray, flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct stretch, and which of them each is. Equal hashes are held against the bytes."""
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    same = sizes == sizes[one[which]]
    held = np.flatnonzero(same & (one[which] != np.arange(len(key))))
    odd = flat[_ranges(at[held], sizes[held])] != flat[_ranges(at[one[which[held]]], sizes[held])]
    same[np.repeat(held, sizes[held])[odd]] = False
    if not same.all():  # hashes that collide: these are told apart by what they hold
        known: dict[tuple, int] = {}
        extra = []
        for i in np.flatnonzero(~same).tolist():
            held_ = (int(key[i]), flat[at[i] : at[i] + sizes[i]].tobytes())
            if held_ not in known:
                known[held_] = len(one) + len(extra)
                extra.append(i)
            which[i] = known[held_]
        one = np.concatenate([one, np.array(extra, one.dtype)])
    return one, which


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of sizes[i], one range after the other."""
    total = int(sizes.sum())
    out = np.ones(total, np.int64)
    sizes_, starts_ = sizes[sizes > 0], starts[sizes > 0]
    if not total:
        return out[:0]
    ends = np.cumsum(sizes_)
    out[0] = starts_[0]
    out[ends[:-1]] = starts_[1:] - (starts_[:-1] + sizes_[:-1] - 1)
    return np.cumsum(out)


def covered(block: Block, found: Stretches, told: dict[int, bytes], n_symbols: int, length: int) -> np.ndarray:
    """True at each symbol in a window that also starts in a document with a smaller id."""
    step = np.zeros(n_symbols + 1, np.int32)
    if told and len(found.key):
        key, frm, to, least = (np.concatenate(x) for x in zip(*map(unpack, told.values()), strict=True))
        order = np.argsort(key, kind="stable")
        key, frm, to, least = key[order], frm[order].astype(np.int64), to[order].astype(np.int64), least[order]
        a, b = np.searchsorted(key, found.key, "left"), np.searchsorted(key, found.key, "right")
        at, row = _ranges(a, b - a), np.repeat(np.arange(len(a)), b - a)
        hit = least[at] < block.ids[found.doc[row]]
        at, row = at[hit], row[hit]
        np.add.at(step, found.first[row] + frm[at], 1)
        np.add.at(step, found.first[row] + to[at] - 1 + length, -1)
    return np.cumsum(step, out=step)[:-1] > 0
