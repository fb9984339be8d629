"""Repeated byte strings by suffix arrays and their common-prefix interval trees.

repeat_groups() is the core on one block of bytes: an array of the suffixes that can
start a repeat, the common-prefix lengths of neighbours, and a stack scan over them that visits every
interval of the tree; an interval whose occurrences have different bytes before them
is a maximal repeat and is given out with all its occurrences.

Over a corpus the block must stay bounded, so the texts are cut down to what can repeat:

A  Every `length`-byte string holds a minimizer, the smallest of the hashes of its
   GRAM-byte strings, at a place that only its bytes decide. Each text's minimizers go,
   with a hash of their surroundings (the strings whose minimizer they are, one after the
   other), packed by chunk and bucket to tasks that sort them. Occurrences with equal
   surroundings (96 bits) are settled there, or already in their chunk: all but those
   of the smallest doc_id are repeats as a whole. What is left are minimizers with
   different surroundings in different documents: edges of repeats.
B  The surroundings of these are read from the texts, each bucket of them is a block,
   and its maximal repeats give the exact borders. A minimizer with more than HOT
   different surroundings (a passage that very many texts share) is split: its strings of
   `length` bytes are combined in each part of the documents and dealt by their bytes, and
   suffixes are sorted by that many bytes only. An occurrence costs about the same either
   way, so that work stays in proportion to the input however many become hot.
C  Spans meet their texts, in parts of bounded size, and are cut out.

A minimizer that has many different surroundings within one chunk (more than CROWD and
than its share of 4 * HOT) sends them, but for one that says so, to tasks dealt by the
surroundings, so that no task meets all of a common string. Representatives of equal surroundings from
both kinds of task are compared by their bytes in B.

A copied text or passage is combined in its chunk before the shuffle: one entry a chunk
and distinct surroundings, however many documents have it.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than
`length` lose none; rows with equal doc_id and text are treated alike and are no source
for each other; rows without doc_id are neither source nor cut; overlaps count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, tidy, tidy_group, tidy_groups

LENGTH, GRAM = 50, 20
#: Bytes of text for each bucket of minimizers, and surroundings in each block.
BUCKET_BYTES, BLOCK_SURROUNDINGS = 4 << 20, 8_000
#: Different surroundings of one minimizer that stay together in a block.
HOT = 16_000
#: Different surroundings of one minimizer that a chunk may send to one task, whatever the
#: input's size: 1 in 8,000 of the chunk's minimizers.
CROWD = 64
#: Strings of hot minimizers in each block of them, and strings or bytes cut out at once, about.
WINDOWS = 250_000
#: Bytes up to which suffixes are compared directly.
SHORT = 256
#: Minimizers that a task packs at once, and bytes of text that it hashes at once.
CHUNK, STEP = 500_000, 1 << 18
#: Bytes of text for one minimizer, about.
SPACING = 15
#: Bytes of text in one part of the documents when spans meet their texts, about.
PART_BYTES = 6 << 20

U = np.uint64
MASK48 = U((1 << 48) - 1)
MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


# ---------------------------------------------------------------- suffix arrays


def suffix_order(text: np.ndarray, ends: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common-prefix lengths with the one before).

    text: bytes; ends: for each byte, where its string ends (no suffix reaches beyond);
    starts: the suffixes to sort; depth: bytes that count. Up to SHORT bytes are compared
    eight at a time; beyond, ranks of 7 bytes are doubled until they cover depth.
    """
    order = _by_bytes(text, ends, starts, depth) if depth <= SHORT else _by_doubling(text, ends, starts, depth)
    return order, _common(text, ends, order, depth)


def _by_bytes(text: np.ndarray, ends: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    width = -(-depth // 8) * 8
    padded = np.r_[text, np.zeros(width, np.uint8)]
    rows = padded[starts[:, None] + np.arange(width)]
    rows[np.arange(width) >= (ends[starts] - starts)[:, None]] = 0  # nothing beyond the end: before all bytes
    words = rows.view(">u8").astype(np.uint64)
    return starts[np.lexsort([ends[starts] - starts, *words.T[::-1]])]  # zero bytes and the end alike: the shorter first


def _by_doubling(text: np.ndarray, ends: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    n = len(text)
    padded = np.r_[text, np.zeros(depth + 8, np.uint8)].astype(np.uint64)
    at = np.arange(n)
    left = np.minimum(ends - at, 8)
    key = np.zeros(n, np.uint64)
    for i in range(7):  # 7 bytes of 9 bits: 0 is beyond the end
        key = key << U(9) | np.where(left > i, padded[i : n + i] + U(1), U(0))
    rank = np.r_[np.unique(key, return_inverse=True)[1] + 1, 0]
    covered = 7
    while covered < depth:
        step = min(covered, depth - covered)
        nxt = at + step
        tail = np.where(nxt < ends, rank[np.minimum(nxt, n)], 0)
        rank = np.r_[np.unique(rank[:n].astype(np.int64) * (n + 2) + tail, return_inverse=True)[1] + 1, 0]
        covered += step
    return starts[np.argsort(rank[starts], kind="stable")]


def _common(text: np.ndarray, ends: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before."""
    a, b = order[:-1], order[1:]
    room = np.minimum(np.minimum(ends[a] - a, ends[b] - b), depth)
    common = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    raw = np.r_[text, np.zeros(depth, np.uint8)]
    for i in range(depth):
        open_ = open_[room[open_] > i]
        open_ = open_[raw[a[open_] + i] == raw[b[open_] + i]]
        if not len(open_):
            break
        common[open_] = i + 1
    return np.r_[0, common] if len(order) else np.zeros(0, np.int64)


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(prefix length, first, last + 1) of the intervals of one suffix array whose prefix
    has `least` bytes or more; a stack holds the open ones."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(common) + 1):
        now, first = (common[i] if i < len(common) else 0), i - 1
        while stack and stack[-1][0] > now:
            size, first = stack.pop()
            yield size, first, i
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def repeat_groups(strings: list[bytes], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of `least` bytes or more: (length, string numbers, offsets).

    Nothing is known of what stands before a string: its first byte's left extension
    differs from all others, so that what a block does not show is never taken as seen.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    if not len(sizes) or sizes.max() < least:
        return
    text = np.frombuffer(b"".join(strings), np.uint8)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(strings)), sizes)
    ends = (first + sizes)[owner]
    starts = np.flatnonzero(ends - np.arange(len(text)) >= least)
    in_front = np.r_[0, text[:-1]].astype(np.int64)
    in_front[first[sizes > 0]] = 256 + np.flatnonzero(sizes > 0)
    # A suffix whose first `least` bytes nothing else has, or all others of which have the
    # same byte in front, starts no maximal repeat: most suffixes end here. Equal strings
    # have equal hashes, so none is lost.
    hasher = Hasher()
    hasher.load(text)
    _, group, members = np.unique(hasher.of(starts, starts + least), return_inverse=True, return_counts=True)
    by = np.argsort(group, kind="stable")
    cuts = np.cumsum(members) - members
    f = in_front[starts][by]
    open_ = (members > 1) & (np.maximum.reduceat(f, cuts) != np.minimum.reduceat(f, cuts))
    starts = starts[open_[group]]
    if not len(starts):
        return
    order, common = suffix_order(text, ends, starts, int(sizes.max()))
    front = in_front[order]
    island = np.cumsum(common < least)
    begin = np.flatnonzero(np.r_[True, island[1:] != island[:-1]])
    size = np.diff(np.r_[begin, len(order)])
    differs = np.maximum.reduceat(front, begin) != np.minimum.reduceat(front, begin)
    for s, n in zip(begin[(size > 1) & differs].tolist(), size[(size > 1) & differs].tolist(), strict=True):
        lcp = common[s : s + n].tolist()
        lcp[0] = 0
        for length, i, j in intervals(lcp, least):
            f = front[s + i : s + j]
            if (f != f[0]).any():  # left extensions differ: the repeat is maximal
                pos = order[s + i : s + j]
                yield length, owner[pos], pos - first[owner[pos]]


# ---------------------------------------------------------------- A: minimizers


class Hasher:
    """Hashes of byte strings inside one buffer, by prefix sums modulo 2**64."""

    def __init__(self):
        self.table = _mix(np.arange(1, 257, dtype=np.uint64))
        self.inverse = np.ones(0, np.uint64)

    def load(self, text: np.ndarray) -> None:
        n = len(text)
        if len(self.inverse) <= n:
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.full(n + 1, MULTIPLIER, np.uint64))
                self.inverse = np.cumprod(np.full(n + 1, pow(MULTIPLIER, -1, 1 << 64), np.uint64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[text] * self.power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i : i + width], for every i where that fits."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


def minimizers(hasher: Hasher, text: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the minimizers of all strings of `length` bytes in the loaded buffer: their places,
    the first string that has them, and how many in a row do."""
    w = length - gram + 1
    if len(text) < length:
        return (np.empty(0, np.int64),) * 3
    at = np.arange(len(text) - gram + 1)
    h = hasher.of(at, at + gram) | U(1)
    low = _sliding(h, w, np.minimum)
    inside = ends[: len(low)] - np.arange(len(low)) >= length
    low = np.where(inside, low, U(0))
    low = np.r_[np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]
    p = np.flatnonzero(_sliding(low, w, np.maximum) == h)
    # Of the strings that start at p - w + 1 to p, those with this minimizer are neighbours.
    own = np.lib.stride_tricks.sliding_window_view(low, w)[p] == h[p, None]
    return p, p - w + 1 + own.argmax(axis=1), own.sum(axis=1)


#: What pack() gives: the smallest doc_id, the bytes of each column's numbers, the entries.
PACKED = "base bigint, widths int, blob binary"


def pack(cell: np.ndarray, doc: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(first entry of each cell, its PACKED columns) of entries in the order of their cells.

    All cells are one buffer of records, cut by offsets: their number, which grows with the
    square of the input, costs no Python call.
    """
    base = doc.min() if len(doc) else np.int64(0)
    numbers = [np.ascontiguousarray(x).astype("<u8") for x in (doc - base, *columns)]
    widths = [max(1, -(-int(x.max(initial=0)).bit_length() // 8)) for x in numbers]
    rows = np.concatenate([x.view(np.uint8).reshape(-1, 8)[:, :w] for x, w in zip(numbers, widths, strict=True)], axis=1)
    new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
    ends = (np.r_[new, len(cell)] * sum(widths)).astype(np.int32)
    blobs = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])
    code = sum(w << 4 * k for k, w in enumerate(widths))
    return new, {"base": pa.array(np.full(len(new), base), pa.int64()), "widths": pa.array(np.full(len(new), code), pa.int32()), "blob": blobs}


def unpack(cells: pa.Table, columns: int) -> list[np.ndarray]:
    """doc and the other columns of all entries, in the order of the cells' widths;
    `columns` counts doc too."""
    out = [[np.empty(0, np.int64)], *([np.empty(0, np.uint64)] for _ in range(columns - 1))]
    codes = cells.column("widths").to_numpy()
    for code in np.unique(codes).tolist():
        mine = cells.filter(pa.array(codes == code))
        widths = [code >> 4 * k & 15 for k in range(columns)]
        blobs = mine.column("blob")
        rows = np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(-1, sum(widths))
        edges = np.cumsum([0, *widths])
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            x = np.zeros((len(rows), 8), np.uint8)
            x[:, : b - a] = rows[:, a:b]
            out[k].append(x.reshape(-1).view("<u8"))
        sizes = pc.binary_length(blobs).to_numpy() // sum(widths)
        out[0][-1] = out[0][-1].view(np.int64) + np.repeat(mine.column("base").to_numpy(), sizes)
    return [np.concatenate(x) for x in out]


def _entries():
    """Number of entries in a blob of PACKED."""
    widths = [F.shiftright("widths", 4 * k).bitwiseAND(F.lit(15)) for k in range(7)]
    return F.octet_length("blob") / sum(widths[1:], widths[0])


def settle(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by h, c; number of the (h, c) group; whether a smaller doc_id has the same)."""
    order = np.lexsort((doc, c, h))
    hs, cs, ds = h[order], c[order], doc[order]
    new = np.r_[True, (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])] if len(hs) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    return order, group, ds > ds[new][group] if len(hs) else new


def _batches(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[list, list, list]]:
    """(doc_ids, fps, texts as bytes) of about `step` bytes; rows without doc_id or text are left out."""
    ids, fps, texts, size = [], [], [], 0
    for big in batches:
        for k in range(0, big.num_rows, 200):
            part = big.slice(k, 200)
            for i, f, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if i is not None and t:
                    ids.append(i), fps.append(f), texts.append(t)
                    size += len(t)
            if size >= step:
                yield ids, fps, texts
                ids, fps, texts, size = [], [], [], 0
    if ids:
        yield ids, fps, texts


class Places:
    """Surroundings as one number: where they start, and how many strings they are."""

    def __init__(self, length: int, gram: int):
        self.length, self.bits = length, (length - gram).bit_length()

    def of(self, lo: np.ndarray, strings: np.ndarray) -> np.ndarray:
        return lo << self.bits | strings - 1

    def spans(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = place >> self.bits
        return lo, lo + (place & (1 << self.bits) - 1) + self.length


def _gather(buckets: int, length: int, gram: int, crowd: int):
    places = Places(length, gram)

    @tidy
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0

        def chunk() -> Iterator[pa.RecordBatch]:
            h, c, doc, fp, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (h >> U(48)).astype(np.int64) * buckets >> 16
            h &= MASK48
            order, same, later = settle(h, c, doc)
            new = np.r_[True, h[order][1:] != h[order][:-1]]
            run = np.cumsum(new) - 1
            many = ~later & (np.bincount(run, np.r_[True, same[1:] != same[:-1]])[run] > crowd)
            settled, crowded = np.empty_like(later), np.empty_like(many)
            settled[order], crowded[order] = later, many
            dealt = order[many & ~new]
            bucket[dealt] = buckets + ((c[dealt] >> U(32)).astype(np.int64) * buckets >> 16)
            for some, hot, done in ((settled, False, True), (~settled & ~crowded, False, False), (crowded, True, False)):
                mine = np.flatnonzero(some)
                mine = mine[np.argsort(bucket[mine], kind="stable")]
                if len(mine):
                    first, packed = pack(bucket[mine], *(x[mine] for x in ((doc, fp, pos) if done else (doc, fp, pos, h, c))))
                    cells = {"bucket": pa.array(bucket[mine][first], pa.int32()), "hot": pa.array(np.full(len(first), hot)), "settled": pa.array(np.full(len(first), done))}
                    yield pa.RecordBatch.from_pydict(cells | packed)

        for ids, fps, texts in _batches(batches, STEP):
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            text = np.frombuffer(b"".join(texts), np.uint8)
            last = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(texts)), sizes)
            hasher.load(text)
            p, lo, strings = minimizers(hasher, text, last[owner], length, gram)
            who = owner[p]
            hi = lo + strings + length - 1
            c = _mix(hasher.of(lo, hi) + (p - lo).astype(np.uint64) * U(257) + (hi - p).astype(np.uint64)) & MASK48
            h = _mix(hasher.of(p, p + gram) + U(MULTIPLIER))  # anew: minimizers are the small hashes
            held.append((h, c, np.array(ids, np.int64)[who], np.array(fps, np.int64).view(np.uint64)[who] & U(0xFFFFFFFF), places.of(lo - (last - sizes)[who], strings)))
            size += len(p)
            if size >= CHUNK:
                yield from chunk()
                held.clear()
                size = 0
        if size:
            yield from chunk()

    return gather


#: Spans that are settled, places whose surroundings go to a block, and hot ones.
SPAN, PLACE, HOT_PLACE = range(3)
SPANS = f"part int, kind int, {PACKED}"


def _by_part(doc, fp, lo, more, parts: int, kind: int) -> pa.Table:
    """SPANS; more: the bytes of a span, or the number of its minimizer."""
    part = doc % parts
    order = np.argsort(part, kind="stable")
    first, packed = pack(part[order], *(x[order] for x in (doc, fp, lo, more)))
    return pa.table({"part": pa.array(part[order][first], pa.int32()), "kind": pa.array(np.full(len(first), kind), pa.int32())} | packed)


def unpack_spans(spans: pa.Table) -> list[np.ndarray]:
    return [x.view(np.int64) for x in unpack(spans, 4)]


def _meet(parts: int, length: int, gram: int, most: int):
    places = Places(length, gram)

    @tidy_group
    def meet(key: tuple, group: pa.Table) -> pa.Table:
        """Of one bucket: spans settled as repeats, and open places that need their bytes."""
        done, hot = (group.column(n).to_numpy() for n in ("settled", "hot"))
        early = unpack(group.filter(pa.array(done)), 3)
        crowded = unpack(group.filter(pa.array(hot)), 5)
        doc, fp, pos, h, c = (np.concatenate(x) for x in zip(crowded, unpack(group.filter(pa.array(~done & ~hot)), 5), strict=True))
        crowded = np.unique(crowded[3])
        order, same, settled = settle(h, c, doc)
        h, doc, fp, pos = (x[order] for x in (h, doc, fp, pos))
        d, f, p = (np.concatenate([x, y[settled]]) for x, y in zip(early, (doc, fp, pos), strict=True))
        lo, hi = places.spans(p.view(np.int64))
        out = [_by_part(d, f, lo, hi - lo, parts, SPAN)]
        h, doc, fp, pos, same = (x[~settled] for x in (h, doc, fp, pos, same))
        if len(h):
            begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[begin, len(h)])
            several = (np.maximum.reduceat(same, begin) != np.minimum.reduceat(same, begin)) & (np.maximum.reduceat(doc, begin) != np.minimum.reduceat(doc, begin))
            distinct = np.add.reduceat(np.r_[True, same[1:] != same[:-1]], begin, dtype=np.int64)
            many = np.isin(h, crowded)
            hot = np.repeat(several & (distinct > most), size) | many
            cool = np.repeat(several, size) & ~hot
            anchor = (h[cool] | U(key[0].as_py()) << U(48)).view(np.int64)
            out.append(_by_part(doc[cool], fp[cool], pos[cool], anchor, parts, PLACE))
            out.append(_by_part(doc[hot], fp[hot], pos[hot], np.zeros(int(hot.sum()), np.int64), parts, HOT_PLACE))
        return pa.concat_tables(out)

    return meet


# ---------------------------------------------------------------- B: surroundings


class Texts:
    """The rows of one part of the documents, found by doc_id and fp."""

    def __init__(self, docs: pa.Table):
        self.at: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(docs.column("doc_id").to_pylist(), docs.column("fp").to_pylist(), strict=True)):
            self.at.setdefault(key, []).append(k)
        self.texts = docs.column("text").cast(pa.binary())

    def __getitem__(self, k: int) -> bytes | None:
        return self.texts[k].as_py()


SURROUNDINGS = f"block int, {PACKED}, body binary"


def _runs(doc: np.ndarray, fp: np.ndarray) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """((doc_id, fp), places in the arrays) of each different pair."""
    order = np.lexsort((fp, doc))
    d, f = doc[order], fp[order]
    edges = np.r_[np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (f[1:] != f[:-1])]), len(d)] if len(d) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield (int(d[a]), int(f[a])), order[a:b]


def _bodies(block: np.ndarray, doc: np.ndarray, fp: np.ndarray, lo: np.ndarray, size: np.ndarray, body: np.ndarray) -> pa.Table:
    """SURROUNDINGS of strings in the order of their blocks; body: their bytes in a row."""
    new, packed = pack(block, doc, fp, lo, size)
    ends = np.r_[0, np.cumsum(size)][np.r_[new, len(block)]].astype(np.int32)
    bodies = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))])
    return pa.table({"block": pa.array(block[new], pa.int32())} | packed | {"body": bodies})


def _turns(amount: np.ndarray) -> list[np.ndarray]:
    """Numbers of the entries, cut where WINDOWS of the amount are full."""
    return np.split(np.arange(len(amount)), np.flatnonzero(np.diff(np.cumsum(amount) // WINDOWS)) + 1)


def _words(rows: np.ndarray) -> np.ndarray:
    """Strings of one length as rows of numbers in their order."""
    n, length = rows.shape
    out = np.zeros((n, -(-length // 8) * 8), np.uint8)
    out[:, :length] = rows
    return out.view(">u8").astype(np.uint64)


def equal_strings(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of the group of equal ones): suffixes sorted by their first bytes only."""
    words = _words(rows)
    order = np.lexsort(words.T[::-1])
    words = words[order]
    return order, np.cumsum(np.r_[True, (words[1:] != words[:-1]).any(axis=1)]) - 1


def _cut_surroundings(blocks: int, hot_blocks: int, length: int, gram: int):
    """Blocks from `blocks` on are those of single strings."""
    places = Places(length, gram)

    def of_hot(text: np.ndarray, start: np.ndarray, doc: np.ndarray, fp: np.ndarray, lo: np.ndarray, strings: np.ndarray, done: int) -> Iterator[pa.Table]:
        """Of places: their strings, for the smallest doc_id here that has each, which
        settles the others."""
        at = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
        who = np.repeat(np.arange(len(start)), strings)
        rows = np.lib.stride_tricks.sliding_window_view(text, length)[start[who] + at]
        doc, fp, lo = doc[who], fp[who], lo[who] + at
        key = np.zeros(len(rows), np.uint64)
        for word in _words(rows).T:
            key = _mix(key * U(31) + word + U(1))
        order = np.lexsort((doc, key))
        rows, doc, fp, lo, key = (x[order] for x in (rows, doc, fp, lo, key))
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        settled = (doc > doc[first]) & (rows == rows[first]).all(axis=1)
        size = np.full(len(rows), length)
        yield _bodies(np.full(int(settled.sum()), done), doc[settled], fp[settled], lo[settled], size[settled] * 0, np.empty(0, np.uint8))
        block = blocks + (key % U(hot_blocks)).astype(np.int64)
        go = np.flatnonzero(~settled)
        go = go[np.argsort(block[go], kind="stable")]
        yield _bodies(block[go], doc[go], fp[go], lo[go], size[go], rows[go])

    @tidy_groups
    def cut(key: tuple, docs: pa.Table, spans: pa.Table) -> pa.Table:
        kinds = spans.column("kind").to_numpy()
        out = [_bodies(*[np.empty(0, np.int64)] * 5, np.empty(0, np.uint8))]
        at = Texts(docs).at
        binary = docs.column("text").cast(pa.large_binary()).combine_chunks()
        ends = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1] if len(binary) else np.zeros(1, np.int64)
        text = np.frombuffer(binary.buffers()[2], np.uint8) if len(binary) else np.empty(0, np.uint8)
        for kind in (PLACE, HOT_PLACE):
            doc, fp, place, anchor = unpack_spans(spans.filter(pa.array(kinds == kind)))
            if not len(doc):
                continue
            lo, end = places.spans(place)
            start = lo.copy()
            for who, mine in _runs(doc, fp):
                start[mine] += ends[at[who][0]]
            if kind == PLACE:
                block, size = (anchor ^ anchor >> 20) % blocks, end - lo
                order = np.argsort(block, kind="stable")
                block, doc, fp, lo, size, start = (x[order] for x in (block, doc, fp, lo, size, start))
                body = [text[np.repeat(start[m] - np.cumsum(size[m]) + size[m], size[m]) + np.arange(size[m].sum())] for m in _turns(size)]
                out.append(_bodies(block, doc, fp, lo, size, np.concatenate(body)))
                continue
            strings = end - lo - length + 1
            for mine in _turns(strings):
                out += of_hot(text, start[mine], doc[mine], fp[mine], lo[mine], strings[mine], -1 - key[0].as_py())
        return pa.concat_tables(out)

    return cut


def _borders(parts: int, blocks: int, length: int):
    @tidy_group
    def borders(key: tuple, group: pa.Table) -> pa.Table:
        group = group.take(np.argsort(group.column("widths").to_numpy(), kind="stable"))  # bodies in the order of the entries
        ids, fps, los, sizes = unpack_spans(group)
        if key[0].as_py() < 0:  # strings that a part of the documents has settled
            return _by_part(ids, fps, los, np.full(len(ids), length), parts, SPAN)
        text = b"".join(group.column("body").to_pylist())
        if key[0].as_py() >= blocks:
            order, same = equal_strings(np.frombuffer(text, np.uint8).reshape(-1, length))
            ids, fps, los = (x[order] for x in (ids, fps, los))
            least = np.minimum.reduceat(ids, np.flatnonzero(np.r_[True, same[1:] != same[:-1]]))
            later = ids > least[same]
            return _by_part(ids[later], fps[later], los[later], np.full(int(later.sum()), length), parts, SPAN)
        ends = np.cumsum(sizes).tolist()
        bodies = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        out = [[np.empty(0, np.int64)] for _ in range(4)]
        for size, which, offset in repeat_groups(bodies, length):
            later = ids[which] > ids[which].min()
            if later.any():
                w = which[later]
                for held, x in zip(out, (ids[w], fps[w], los[w] + offset[later], np.full(len(w), size)), strict=True):
                    held.append(x)
        return _by_part(*(np.concatenate(x) for x in out), parts, SPAN)

    return borders


def _prime(n: int) -> int:
    """The next prime: numbers modulo it spread whatever steps the ids have."""
    n |= 1
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def _crowd(total: int, hot: int) -> int:
    """Different surroundings from which a minimizer is crowded in a chunk of `total` bytes."""
    return int(max(1, min(CROWD, 4 * hot), 4 * hot * CHUNK * SPACING // max(total, CHUNK * SPACING)))


def repeat_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[int, DataFrame]:
    """docs has doc_id, fp and text; result: (parts, SPANS): blobs of the byte spans whose
    strings also start in smaller doc_ids, of the documents with doc_id % parts = part."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(1 << 16, max(64, total // BUCKET_BYTES))
    parts = _prime(max(64, total // PART_BYTES))
    gathered = docs.select("doc_id", "fp", "text").mapInArrow(_gather(buckets, length, gram, _crowd(total, hot)), f"bucket int, hot boolean, settled boolean, {PACKED}")
    found = materialize(gathered.groupBy("bucket").applyInArrow(_meet(parts, length, gram, hot), SPANS), "repeat-places")
    wanted = found.filter(F.col("kind") != SPAN)
    places = {r.kind: r.n for r in wanted.groupBy("kind").agg(F.sum(_entries()).alias("n")).collect()}
    blocks = int(max(64, places.get(PLACE, 0) // BLOCK_SURROUNDINGS))
    hot_blocks = int(max(64, places.get(HOT_PLACE, 0) * SPACING // WINDOWS))
    with_part = docs.select(_part(parts).alias("part"), "doc_id", "fp", "text").filter("text <> ''")
    cut = with_part.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(_cut_surroundings(blocks, hot_blocks, length, gram), SURROUNDINGS)
    fine = materialize(cut.groupBy("block").applyInArrow(_borders(parts, blocks, length), SPANS), "repeat-borders")
    return parts, found.filter(F.col("kind") == SPAN).union(fine)


def _part(parts: int):
    return F.coalesce(F.pmod("doc_id", F.lit(parts)), F.lit(0)).cast("int")


def merge_spans(lo: np.ndarray, hi: np.ndarray, size: int) -> np.ndarray:
    """Maximal runs (start, end) of a text of `size` bytes."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.minimum(hi[order], size)
    reach = np.maximum.accumulate(hi)
    new = np.r_[True, lo[1:] > reach[:-1]]
    return np.stack([lo[new], np.r_[reach[:-1][new[1:]], reach[-1]]], axis=1)


def _remover(kept_columns: list[str] | None):
    @tidy_groups
    def remove(key: tuple, docs: pa.Table, spans: pa.Table) -> pa.Table:
        doc, fp, lo, size = unpack_spans(spans)
        hi = lo + size
        texts = Texts(docs)
        cut = {k: merge_spans(lo[m], hi[m], len(texts[i])).tolist() for key, m in _runs(doc, fp) for i in texts.at[key][:1] for k in texts.at[key]}
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        for k in range(docs.num_rows):
            t, runs = texts[k], cut.get(k, [])
            body = t or b""
            out["n_bytes"].append(len(body)), out["n_spans"].append(len(runs)), out["n_removed"].append(sum(b - a for a, b in runs))
            out["kept_sha256"].append(hashlib.sha256(_without(body, runs)).hexdigest())
            if kept_columns is not None:
                whole = [_whole_chars(body, a, b) for a, b in runs]
                out["kept_text"].append(_without(body, whole).decode("utf-8", "replace") if t is not None else None)
        cols = {n: docs.column(n) for n in ("doc_id", *(kept_columns or []))}
        cols |= {n: pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")}
        cols["kept_sha256"] = pa.array(out["kept_sha256"], pa.string())
        if kept_columns is not None:
            cols["kept_text"] = pa.array(out["kept_text"], pa.string())
        return pa.table(cols)

    return remove


def _without(body: bytes, runs: list) -> bytes:
    at, out = 0, []
    for lo, hi in runs:
        out.append(body[at:lo])
        at = hi
    return b"".join([*out, body[at:]])


def _whole_chars(body: bytes, lo: int, hi: int) -> tuple[int, int]:
    """The characters that lie inside a run as a whole."""
    while lo < hi and body[lo] & 0xC0 == 0x80:
        lo += 1
    while hi > lo and hi < len(body) and body[hi] & 0xC0 == 0x80:
        hi -= 1
    return lo, hi


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, the columns `keep`, n_bytes, n_removed, n_spans, kept_sha256 and, where
    columns to keep are named, kept_text: the characters that are not covered as a whole."""
    others = {f"__k{i}": F.col(c) for i, c in enumerate(keep or [])}
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[c.alias(n) for n, c in others.items()])
    base = base.withColumn("fp", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))
    parts, spans = repeat_spans(base, length, hot=hot)
    extra = "".join(f", {n} {base.schema[n].dataType.simpleString()}" for n in others)
    result = (
        base.withColumn("part", _part(parts))
        .groupBy("part")
        .cogroup(spans.groupBy("part"))
        .applyInArrow(
            _remover(list(others) if keep is not None else None),
            f"doc_id bigint{extra}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept_text string" if keep is not None else ""),
        )
    )
    return result.withColumnsRenamed({f"__k{i}": c for i, c in enumerate(keep or [])})


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
