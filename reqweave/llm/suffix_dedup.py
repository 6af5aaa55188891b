"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Suffixes are compared by prefix polynomial hashes:
a binary search over lengths finds how far two suffixes agree, so a comparison takes
a logarithmic number of steps, and a mergesort on such comparisons brings equal
strings together. The order is verified byte by byte: where a collision of hashes led it astray, the bytes sort anew.

Which suffixes have to meet is decided by anchors. Each string of LENGTH bytes has
one anchor, the k-gram in it with the least hash, so equal strings have equal
anchors at equal places. Neighbouring strings mostly share theirs: an anchor
stands for about 13 suffixes, which travel as one context of up to 76 bytes. Only
anchors that occur in several documents travel at all. Contexts that are equal as
a whole are one class, made first in each pack of documents and then among packs:
all but the class's least document are covered, and one suffix set a class is sorted.

Documents travel in packs of a few megabytes with whole numpy arrays as values, so Spark
moves few rows; hashes decide the part (a fixed share of all anchors) that a context goes to.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work, lean

LENGTH, GRAM = 50, 24
GRAMS = LENGTH - GRAM + 1  # k-grams in a string, and strings that an anchor can stand for
CONTEXT = LENGTH + GRAMS - 1
PACK = 2 << 20
#: Bytes of rows that become Python's objects at once, about.
HELD = 1 << 20
#: Anchors of a part, at most about; parts grow in number with the text.
PART_ANCHORS = 1_000_000
#: Rows of contexts that are sorted at once; an anchor's contexts stay together.
SORTED = 4_000
#: An anchor with more contexts than this, of all packs (5 MB), is frequent: of its strings those that occur more than once, told by
#: their own hashes, travel one by one, dealt by these, so no part gathers all that surrounds a common phrase.
FREQUENT = 50_000
BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64
NO_ID = np.iinfo(np.int64).max


class PrefixHash:
    """Polynomial hashes modulo 2^64 of all substrings of a byte array."""

    _powers = np.ones(1, U64)
    _inverse = np.ones(1, U64)

    @classmethod
    def _tables(cls, n: int) -> None:
        if len(cls._powers) < n:
            n = max(n, 1 << 12)
            with np.errstate(over="ignore"):
                for name, base in (("_powers", BASE), ("_inverse", pow(BASE, -1, 1 << 64))):
                    t = np.full(n, base, U64)
                    t[0] = 1
                    setattr(cls, name, np.multiply.accumulate(t))

    def __init__(self, data: np.ndarray):
        self._tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        terms = data.astype(U64)
        terms += U64(1)
        terms *= self._powers[: len(data)]
        np.cumsum(terms, out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, U64)
        out = self.sums[k:] - self.sums[:n]
        out *= self._inverse[:n]
        return out

    def of(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self._inverse[at]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many bytes the strings at a and b have in common, ``most`` at most, by binary search."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
        same = self.of(a, most) == self.of(b, most)
        lo[same] = most
        rest = np.flatnonzero(~same)
        hi[rest] -= 1
        while len(rest):
            mid = (lo[rest] + hi[rest] + 1) >> 1
            ok = self.of(a[rest], mid) == self.of(b[rest], mid)
            lo[rest[ok]], hi[rest[~ok]] = mid[ok], mid[~ok] - 1
            rest = rest[lo[rest] < hi[rest]]
        return lo


def mix(h: np.ndarray) -> np.ndarray:
    """Polynomial hashes have weak low bits; this spreads them."""
    h = h.copy()
    for _ in range(2):
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def row_hash(rows: np.ndarray) -> np.ndarray:
    """A polynomial hash of each row of bytes, four at a time."""
    words = rows.view("<u4")
    PrefixHash._tables(words.shape[1])
    powers, out = PrefixHash._powers[: words.shape[1]], np.empty(len(words), U64)
    for k in range(0, len(words), SORTED):
        out[k : k + SORTED] = ((words[k : k + SORTED].astype(U64) + U64(1)) * powers).sum(axis=1)
    return out


class Anchors:
    """The anchors of a pack: hash, place, and the first and last start of the strings each stands for."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data, self.ends = data, ends
        self.prefix = PrefixHash(data)
        grams = mix(self.prefix.grams(GRAM))
        empty = np.zeros(0, np.int64)
        self.at = self.first = self.last = self.doc = empty
        self.hash = np.zeros(0, U64)
        if len(data) < LENGTH:
            return
        least = grams >> U64(32)
        least <<= U64(32)
        least |= np.arange(len(grams), dtype=U64)  # ties: the leftmost
        width = 1
        while width * 2 <= GRAMS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (GRAMS - width)], least[GRAMS - width :])
        starts = np.r_[0, ends[:-1]]
        whole = np.zeros(len(least) + 1, np.int8)  # strings that lie within one document
        long = ends - starts >= LENGTH
        np.add.at(whole, starts[long], 1)
        np.add.at(whole, ends[long] - LENGTH + 1, -1)
        string = np.flatnonzero(np.cumsum(whole[:-1]))
        place = (least[string] & U64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        self.at, self.first = place[new], string[new]
        self.last = string[np.r_[new[1:], len(string)] - 1]
        self.hash = mix(grams[self.at] ^ U64(BASE))  # least hashes lie close to zero: mixed again they spread over all parts
        self.doc = np.searchsorted(ends, self.first, side="right")

    def strings(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, document and hash of each string that the anchors ``i`` stand for."""
        n = self.last[i] - self.first[i] + 1
        start = np.repeat(self.first[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return start, np.repeat(self.doc[i], n), mix(self.prefix.of(start, LENGTH) + U64(LENGTH))

    def select(self, few: np.ndarray, start: np.ndarray, doc: np.ndarray, own: np.ndarray) -> None:
        """Only the anchors ``few``, and single strings, each an anchor of itself."""
        self.doc = np.r_[self.doc[few], doc]
        self.hash = np.r_[self.hash[few], own]
        self.at, self.first, self.last = (np.r_[x[few], start] for x in (self.at, self.first, self.last))

    def context_hash(self) -> np.ndarray:
        """Equal for anchors with equal contexts and equal places in them."""
        length = self.last - self.first + LENGTH
        return mix(self.prefix.of(self.first, length) ^ mix(((self.at - self.first) * 128 + length).astype(U64)))

    def contexts(self, i: np.ndarray) -> np.ndarray:
        """The contexts' bytes, filled up with zeros."""
        length = (self.last - self.first + LENGTH)[i]
        at = self.first[i, None] + np.arange(CONTEXT)
        out = self.data[np.minimum(at, len(self.data) - 1)]
        out[np.arange(CONTEXT) >= length[:, None]] = 0
        return out


def classes(key: np.ndarray, doc: np.ndarray, rows) -> tuple[np.ndarray, np.ndarray]:
    """Of entries with equal ``key``: each one's class leader, the entry with the least document.

    ``rows(i)`` gives what must be equal; an entry that only its key likens to its leader leads itself.
    """
    order = np.lexsort((doc, key))
    new = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.zeros(0, bool)
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    for k in range(0, len(order), SORTED):
        i = np.arange(k, min(k + SORTED, len(order)))
        i = i[leader[i] != i]
        wrong = i[(rows(i) != rows(leader[i])).any(axis=1)]
        leader[wrong] = wrong
    return leader, leader == np.arange(len(order))


def merge_sort(suffix: np.ndarray, group: np.ndarray, prefix: PrefixHash, data: np.ndarray) -> np.ndarray:
    """Positions of ``suffix`` sorted by (group, string); ``group`` ascends. All groups' merges run side by side."""
    order = np.arange(len(suffix))
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    base, most = np.repeat(start, size), np.repeat(size, size)
    local = order - base
    width = 1
    while len(size) and width < size.max():
        live = np.flatnonzero(most > width)  # the others are sorted
        block = local[live] // (2 * width) * (2 * width)
        right = (local[live] - block) >= width
        lo = np.where(right, block, block + width)
        hi = np.minimum(np.where(right, block + width, block + 2 * width), most[live])
        first, mine = np.minimum(lo, hi), suffix[order[live]]
        lo, hi = first.copy(), np.maximum(hi, first)
        todo = np.flatnonzero(lo < hi)
        while len(todo):  # how many of the sibling run come before each
            mid = (lo[todo] + hi[todo]) >> 1
            other = suffix[order[base[live[todo]] + mid]]
            same = prefix.common(mine[todo], other, LENGTH)
            k = np.minimum(same, LENGTH - 1)
            less = data[other + k] < data[mine[todo] + k]
            before = np.where(same == LENGTH, right[todo], less)
            lo[todo[before]], hi[todo[~before]] = mid[before] + 1, mid[~before]
            todo = todo[lo[todo] < hi[todo]]
        within = local[live] - block - np.where(right, width, 0)
        to = base[live] + block + within + (lo - first)
        moved = order.copy()
        moved[to] = order[live]
        order = moved
        width *= 2
    return order


def covered(contexts: np.ndarray, length: np.ndarray, rel: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each context a mask: bit i is set if its i-th string is also in a context of a smaller document.

    Contexts are classes of anchors; only those with the same anchor and place in it can hold equal strings.
    """
    mask = np.zeros(len(contexts), np.uint32)
    order = np.argsort(anchor, kind="stable")
    new = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1]])
    sizes = np.diff(np.r_[new, len(order)])
    keep = np.repeat(sizes > 1, sizes)
    order, sizes = order[keep], sizes[sizes > 1]
    edge = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        lead = edge[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(edge, lead + SORTED)))
        _sort_block(order[lead : edge[upto - 1]], contexts, length, rel, anchor, doc, mask)
        at = upto
    return mask


def _sort_block(i, contexts, length, rel, anchor, doc, mask) -> None:
    data = contexts[i].ravel()
    prefix = PrefixHash(data)
    n = length[i] - LENGTH + 1
    row = np.repeat(np.arange(len(i)), n)
    off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    suffix = row * CONTEXT + off
    left = rel[i][row] - off
    lead = data[suffix[:, None] + np.arange(8)].view(">u8")[:, 0]  # the first bytes, as a number
    order = np.lexsort((lead, left, anchor[i][row]))
    key = np.stack([anchor[i][row][order], left[order].astype(U64), lead[order]], axis=1)
    group = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(axis=1)])
    merged = merge_sort(suffix[order], group, prefix, data)
    if len(merged) and np.bincount(merged).max() > 1:  # collisions made comparisons contradict each other
        merged = _by_bytes(data, suffix[order], group)
    order = order[merged]
    alike, wrong = _neighbours(data, suffix[order], group)
    if wrong.any():  # hashes collided in these groups
        again = np.flatnonzero(np.isin(group, group[1:][wrong]))
        order[again] = order[again][_by_bytes(data, suffix[order[again]], group[again])]
        alike, _ = _neighbours(data, suffix[order], group)
    s = suffix[order]
    run = np.flatnonzero(np.r_[True, ~alike]) if len(s) else np.zeros(0, np.int64)
    d = doc[i][row[order]]
    least = np.repeat(np.minimum.reduceat(d, run), np.diff(np.r_[run, len(d)])) if len(d) else d
    hit = order[d > least]
    np.bitwise_or.at(mask, i[row[hit]], np.uint32(1) << off[hit].astype(np.uint32))


def _neighbours(data: np.ndarray, s: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes in order, whether each is the same string as the one before in its group, and whether it should have come before it."""
    alike, wrong = np.zeros(max(0, len(s) - 1), bool), np.zeros(max(0, len(s) - 1), bool)
    within = np.flatnonzero(group[1:] == group[:-1])
    for k in range(0, len(within), SORTED):
        p = within[k : k + SORTED]
        x, y = data[s[p, None] + np.arange(LENGTH)], data[s[p + 1, None] + np.arange(LENGTH)]
        differ = x != y
        at = differ.argmax(axis=1)
        each = np.arange(len(p))
        alike[p] = ~differ[each, at]
        wrong[p] = x[each, at] > y[each, at]
    return alike, wrong


def _by_bytes(data: np.ndarray, s: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of suffixes by group and bytes."""
    rows = np.zeros((len(s), -(-LENGTH // 8) * 8), np.uint8)
    rows[:, :LENGTH] = data[s[:, None] + np.arange(LENGTH)]
    return np.lexsort((*rows.view(">u8").T[::-1], group))


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows, a few megabytes at a time: one may be megabytes, or thousands of them none."""
    for batch in batches:
        step = max(1, batch.num_rows * HELD // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield from batch.slice(i, step).to_pylist()


_PACK = [("pack", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("ends", pa.binary()), ("data", pa.binary())]


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    held, total = [], 0

    def row():
        data = [d for _, d in held]
        ids = np.array([NO_ID if i is None else i for i, _ in held], np.int64)
        nulls = np.array([i is None for i, _ in held], np.uint8)
        return (number, _blob(ids), _blob(nulls), _blob(np.cumsum([len(d) for d in data], dtype=np.int64)), b"".join(data))

    for batch in batches:
        for i, text in zip(batch.column(0), batch.column(1)):
            data = (text.as_py() or "").encode()
            if held and total + len(data) > PACK:
                yield _batch([row()], _PACK)
                number, held, total = number + 1, [], 0
            held.append((i.as_py(), data))
            total += len(data)
    if held:
        yield _batch([row()], _PACK)


def _open(ids: bytes, ends: bytes, data: bytes) -> tuple[np.ndarray, Anchors]:
    return np.frombuffer(ids, np.int64), Anchors(np.frombuffer(data, np.uint8), np.frombuffer(ends, np.int64))


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def _parts(total: int, tasks: int) -> int:
    """The number of parts for so many bytes of text: as many for each task."""
    return tasks * max(1, -(-total // (13 * PART_ANCHORS * tasks)))


def _runs(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else []
    for a, b in zip(edges, [*edges[1:], len(sorted_)]):
        yield int(sorted_[a]), int(a), int(b)


_KEYS = [("part", pa.int64()), ("pack", pa.int64()), ("keys", pa.binary())]
_SHARED = [*_KEYS, ("often", pa.binary()), ("n_often", pa.int64())]


def _keys_of(h: np.ndarray, doc: np.ndarray, told: np.ndarray, pack: int, parts: int) -> pa.RecordBatch:
    """Hashes of a pack by part: one that several of its documents have as often as it has different ``told`` (twice at least), others once."""
    order = np.lexsort((told, h))
    h, d, c = h[order], doc[order], told[order]
    if len(h):
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        several = np.maximum.reduceat(d, start) != np.minimum.reduceat(d, start)
        new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
        times = np.where(several, np.maximum(2, np.add.reduceat(new.astype(np.int64), start)), 1)
        h = np.repeat(h[start], times)
    low = (h & U64(0xFFFFFFFF)).astype(np.uint32)
    return _batch([(p, pack, _blob(low[x:y])) for p, x, y in _runs(_part(h, parts))], _KEYS)


class _Wanted:
    """The hashes of a pack that others have too, and whether they are frequent."""

    def __init__(self, shared: list[dict] | None):
        rows = shared or []
        keys = np.concatenate([np.zeros(0, U64), *[(U64(r["part"]) << U64(32)) | np.frombuffer(r["keys"], np.uint32) for r in rows]])
        order = np.argsort(keys)
        self.keys, self.often = keys[order], np.concatenate([np.zeros(0, bool), *[np.frombuffer(r["often"], bool) for r in rows]])[order]

    def among(self, h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """For each hash whether it is wanted, and whether it is frequent."""
        if not len(self.keys):
            return np.zeros(len(h), bool), np.zeros(len(h), bool)
        key = (_part(h, parts).astype(U64) << U64(32)) | (h & U64(0xFFFFFFFF))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return found, found & self.often[at]


def _anchor_keys(parts: int):
    """Of each pack the hashes of its anchors by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            ids, a = _open(r["ids"], r["ends"], r["data"])
            yield _keys_of(a.hash, ids[a.doc], a.context_hash(), r["pack"], parts)

    return run


def _string_keys(parts: int):
    """Of each pack the hashes of its frequent anchors' strings by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            ids, a = _open(r["ids"], r["ends"], r["data"])
            _, often = _Wanted(r["shared"]).among(a.hash, parts)
            _, doc, own = a.strings(np.flatnonzero(often))
            yield _keys_of(own, ids[doc], own, r["pack"], parts)

    return run


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each part, from rows sorted by part."""
    part, held = None, []
    for r in _rows(batches):
        if r["part"] != part:
            if held:
                yield part, held
            part, held = r["part"], []
        held.append(r)
    if held:
        yield part, held


def _shared_keys(frequent: int):
    """The hashes of a part that came more than once, and whether often, back to the packs they came from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _parts_of(batches):
            each = [np.frombuffer(r["keys"], np.uint32) for r in rows]
            keys = np.concatenate(each)
            pack = np.repeat(np.arange(len(rows)), [len(k) for k in each])
            order = np.argsort(keys, kind="stable")
            start = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, np.int64)
            size = np.diff(np.r_[start, len(keys)])
            times = np.empty(len(keys), np.int64)
            times[order] = np.repeat(size, size)
            order = np.flatnonzero(times > 1)
            order = order[np.lexsort((keys[order], pack[order]))]
            mine, of = keys[order], pack[order]
            new = np.r_[True, (mine[1:] != mine[:-1]) | (of[1:] != of[:-1])] if len(order) else np.zeros(0, bool)
            mine, of, often = mine[new], of[new], times[order[new]] > frequent
            so_far = np.r_[0, np.cumsum(often)].tolist()
            out = [(part, rows[p]["pack"], _blob(mine[x:y]), _blob(often[x:y]), so_far[y] - so_far[x]) for p, x, y in _runs(of)]
            yield _batch(out, _SHARED)

    return run


_FOUND = [("kind", pa.string()), ("part", pa.int64()), ("pack", pa.int64()), ("meta", pa.binary()), ("bytes", pa.binary())]
_META = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("first", "<i8"), ("rel", "u1"), ("length", "u1")])


def _contexts(parts: int):
    """Of each pack: what its own classes settle (kind own), and one context a class for each part (kind context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            ids, a = _open(r["ids"], r["ends"], r["data"])
            found, often = _Wanted(r["shared"]).among(a.hash, parts)
            start, of, own = a.strings(np.flatnonzero(often))
            kept, _ = _Wanted(r["strings"]).among(own, parts)
            a.select(np.flatnonzero(found & ~often), start[kept], of[kept], own[kept])
            part = _part(a.hash, parts)
            doc = ids[a.doc]
            leader, leads = classes(a.hash ^ mix(a.context_hash()), doc, lambda x: _told(a, x))
            after = doc > doc[leader]
            same = ~after & ~leads
            rows = [("own", 0, r["pack"], _blob(np.stack([a.first[after], a.last[after]])), None),
                    ("same", 0, r["pack"], _blob(np.stack([a.first[same], a.first[leader[same]]])), None)]
            lead = np.flatnonzero(leads)
            lead = lead[np.argsort(part[lead], kind="stable")]
            meta = np.empty(len(lead), _META)
            meta["hash"], meta["doc"], meta["first"] = a.hash[lead], doc[lead], a.first[lead]
            meta["rel"], meta["length"] = a.at[lead] - a.first[lead], a.last[lead] - a.first[lead] + LENGTH
            for p, x, y in _runs(part[lead]):
                rows.append(("context", p, r["pack"], meta[x:y].tobytes(), _blob(a.contexts(lead[x:y]))))
            yield _batch(rows, _FOUND)

    return run


def _told(a: Anchors, i: np.ndarray) -> np.ndarray:
    rel, length = a.at[i] - a.first[i], a.last[i] - a.first[i] + LENGTH
    return np.concatenate([a.contexts(i), rel[:, None].astype(np.uint8), length[:, None].astype(np.uint8)], axis=1)


_MASKS = [("pack", pa.int64()), ("first", pa.binary()), ("mask", pa.binary())]


def _covered_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of a part's contexts; masks go back to the packs."""
    for _, rows in _parts_of(batches):
        metas = [np.frombuffer(r["meta"], _META) for r in rows]
        meta = np.concatenate(metas)
        pack = np.repeat(np.arange(len(rows)), [len(m) for m in metas])
        contexts = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8).reshape(-1, CONTEXT)
        length, rel, doc = meta["length"].astype(np.int64), meta["rel"].astype(np.int64), meta["doc"].astype(np.int64)
        told = lambda x: np.concatenate([contexts[x], meta["rel"][x, None], meta["length"][x, None]], axis=1)
        key = mix(row_hash(contexts) ^ mix(meta["hash"] ^ mix((rel * 128 + length).astype(U64))))
        leader, leads = classes(key, doc, told)
        lead = np.flatnonzero(leads)
        mask = np.zeros(len(meta), np.uint32)
        mask[lead] = covered(contexts[lead], length[lead], rel[lead], meta["hash"][lead], doc[lead])
        full = ((U64(1) << (length - LENGTH + 1).astype(U64)) - U64(1)).astype(np.uint32)
        mask = np.where(doc > doc[leader], full, mask[leader])
        hit = np.flatnonzero(mask)
        yield _batch([(rows[p]["pack"], _blob(meta["first"][hit[x:y]].astype(np.int64)), _blob(mask[hit[x:y]])) for p, x, y in _runs(pack[hit])], _MASKS)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = [("id", pa.int64()), ("n_bytes", pa.int64()), ("removed", _SPANS), ("kept", pa.binary())]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the covered bytes of a pack's documents and takes them out."""
    for r in _rows(batches):
        data, ends = np.frombuffer(r["data"], np.uint8), np.frombuffer(r["ends"], np.int64)
        step = np.zeros(len(data) + 1, np.int32)
        masks: dict[str, list] = {"own": [], "same": []}
        for x in r["found"] or ():
            masks[x["kind"]].append(np.frombuffer(x["meta"], np.int64).reshape(2, -1))
        for first, last in masks["own"]:
            np.add.at(step, first, 1)
            np.add.at(step, last + LENGTH, -1)
        first = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(m["first"], np.int64) for m in r["masks"] or ()]])
        mask = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(m["mask"], np.uint32) for m in r["masks"] or ()]])
        order = np.argsort(first)
        first, mask = first[order], mask[order]
        for mine, leads in masks["same"]:  # further occurrences in the least document share its mask
            at = np.minimum(np.searchsorted(first, leads), max(len(first) - 1, 0))
            ok = first[at] == leads if len(first) else np.zeros(len(leads), bool)
            first, mask = np.concatenate([first, mine[ok]]), np.concatenate([mask, mask[at[ok]]])
        for bit in range(GRAMS):
            on = first[(mask >> np.uint32(bit) & np.uint32(1)) == 1] + bit
            np.add.at(step, on, 1)
            np.add.at(step, on + LENGTH, -1)
        gone = np.cumsum(step[:-1]) > 0
        out, start = [], 0
        for i, null, end in zip(np.frombuffer(r["ids"], np.int64).tolist(), r["nulls"], ends.tolist()):
            g = gone[start:end]
            edge = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8))).reshape(-1, 2)
            spans = [{"start": a, "end": b} for a, b in edge.tolist()]
            out.append((None if null else i, end - start, spans, data[start:end][~g].tobytes() if len(edge) else data[start:end].tobytes()))
            start = end
        yield _batch(out, _RESULT)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: id, n_bytes, removed (spans of bytes), kept (the remaining bytes).

    Texts are their UTF-8 bytes, null texts empty. Strings are judged on the input, so what removed text
    covers elsewhere is removed too. A null id comes after all others; rows with equal ids are one
    document and don't cover each other. Texts shorter than the length are never touched. A
    document is never split: a task holds a pack of a few megabytes, or one longer document.
    """
    spark = docs.sparkSession
    work = Work(spark, "suffix")
    ddl = lambda fields: ", ".join(f"{n} {({pa.int64(): 'long', pa.string(): 'string', pa.binary(): 'binary'})[t]}" for n, t in fields)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packs = work.save(rows.mapInArrow(lean(_packs), ddl(_PACK)), "packs")
    total = packs.agg(F.sum(F.length("data"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = _parts(total, tasks)

    whole = packs.select("pack", "ids", "ends", "data")

    def by_part(rows: DataFrame) -> DataFrame:
        """Each part in a task, as many of them in each."""
        return rows.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part")

    def shared_by(keys: DataFrame, often: int, name: str) -> DataFrame:
        """(pack, name, n_often): a list of a pack's shared hashes, as many as it has at most."""
        shared = work.save(by_part(keys).mapInArrow(lean(_shared_keys(often)), ddl(_SHARED)), name)
        return shared.groupBy("pack").agg(F.collect_list(F.struct("part", "keys", "often")).alias(name), F.sum("n_often").alias("n_often"))

    anchors = shared_by(whole.mapInArrow(lean(_anchor_keys(parts)), ddl(_KEYS)), frequent, "shared")
    work.keep_only("packs", "shared")
    wanted = whole.join(anchors, "pack")
    hot = wanted.where("n_often > 0").drop("n_often")
    if work.read("shared").where("n_often > 0").isEmpty():  # nothing is frequent here
        wanted = wanted.withColumn("strings", F.lit(None).cast("array<struct<part: long, keys: binary, often: binary>>"))
    else:
        wanted = wanted.join(shared_by(hot.mapInArrow(lean(_string_keys(parts)), ddl(_KEYS)), NO_ID, "strings").drop("n_often"), "pack", "left")
        work.keep_only("packs", "shared", "strings")

    found = wanted.drop("n_often").mapInArrow(lean(_contexts(parts)), ddl(_FOUND))
    found = work.save(found, "found", by="kind")
    work.keep_only("packs", "found")

    contexts = found.where("kind = 'context'").select("part", "pack", "meta", "bytes")
    masks = work.save(by_part(contexts).mapInArrow(lean(_covered_parts), ddl(_MASKS)), "masks")
    work.drop("found/kind=context")
    work.keep_only("packs", "found", "masks")

    own = found.where("kind <> 'context'").groupBy("pack").agg(F.collect_list(F.struct("kind", "meta")).alias("found"))
    back = masks.groupBy("pack").agg(F.collect_list(F.struct("first", "mask")).alias("masks"))
    joined = packs.join(own, "pack", "left").join(back, "pack", "left")
    schema = "id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary"
    return joined.mapInArrow(lean(_removed), schema).withColumnRenamed("id", id_col)


assert sys.byteorder == "little"  # arrays travel as they lie in memory
