"""Suffix-array dedup: remove every byte that a LENGTH-byte string covers which also starts earlier in the corpus.

A corpus does not fit one suffix array, so its strings are first brought together:

1. Anchors. The least hashed GRAM-byte string of each LENGTH-byte window is its anchor (the leftmost, on ties). Equal
   windows have equal anchors at equal offsets. Windows in a row that share an anchor are one slice, some 130 bytes
   from the first window's start to the last one's end.
2. Slices meet by their anchor's hash. Equal slices (anchor hash and slice hash, 128 bits) collapse to the first;
   every window of a later one starts earlier too. This is done within each task before the shuffle, so an anchor
   that a third of all documents share sends one slice for each task.
3. Where several different slices share an anchor (at the ends of a repeated passage and around edits), their bytes
   are fetched and a block of them gets its suffix array (prefix doubling) with common lengths. From the previous and
   the next smaller start in suffix order comes the longest-previous-factor array, counted up to LENGTH: windows
   where it reaches LENGTH start earlier, too, and go; the first stays.
4. The windows found give spans of bytes, which are joined to their document and cut out.

Step 2 is a pre-aggregation: a later equal slice needs no array, as its previous factor is the whole first one.

Matches never cross documents; the text is judged as it came in, overlaps count, in one document too.

Cases: null and empty texts and those shorter than LENGTH lose nothing. Texts of any length are read whole, in pieces
that overlap by LENGTH - 1 bytes. Equal or null doc_ids are told apart by their text's order; repeated rows are
copies of the first. Cut bytes may leave a part of a character, so what is kept is bytes, not text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, mix, releasing, stage

LENGTH = 100
GRAM = 32
PIECE = 1 << 18
FLUSH = 400_000
_rng = np.random.default_rng(8)
_TABLE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(0, 1 << 62, 5)]
_R = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 20) - 1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 2 * PIECE)
        for name, base in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def _slide(m: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m


def anchors(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Slices of the pieces: anchor hash, slice hash, piece number, start in the piece, number of windows."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n, lens = len(data), np.array([len(p) for p in pieces])
    none = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < length:
        return none
    h = _TABLE[data]
    for k, a in enumerate(_STEPS):
        s = 1 << k
        h = h[:-s] * a + h[s:]
    h = mix(h)
    least = _slide((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    at = (least & _LOW).astype(np.int64)
    ends = np.cumsum(lens)
    piece = np.repeat(np.arange(len(lens)), lens)[: len(at)]
    v = np.flatnonzero(np.arange(len(at)) + length <= ends[piece])
    if not len(v):
        return none
    new = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1] + 1) | (at[v[1:]] != at[v[:-1]]))))
    start, count = v[new], np.diff(np.append(new, len(v)))
    stop = start + count - 1 + length
    up, down = _power(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[:n])))
    content = (sums[stop] - sums[start]) * down[start]
    content = mix(content + count.astype(np.uint64) * _STEPS[0] + (at[start] - start).astype(np.uint64) * _STEPS[1])
    return h[at[start]], content, piece[start], start - (ends - lens)[piece[start]], count


def _collapse(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """One batch of slices; all but the first of equal ones become copies, spread by a key of their own."""
    a, c, key, pos, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pos, key, c, a))
    a, c, key, pos, count = a[order], c[order], key[order], pos[order], count[order]
    copy = np.concatenate(([False], (a[1:] == a[:-1]) & (c[1:] == c[:-1])))
    a[copy] = mix(key[copy].astype(np.uint64) * _STEPS[2] + pos[copy].astype(np.uint64))
    place = pos << 16 | count << 1 | copy
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(key), pa.array(place)], names=["a", "c", "key", "place"])


def _slices(length: int):
    @releasing
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        pieces, keys, offsets, size = [], [], [], 0

        def close() -> None:
            nonlocal held, size
            a, c, p, s, count = anchors(pieces, length)
            if len(a):
                parts.append((a, c, np.array(keys, np.int64)[p], np.array(offsets, np.int64)[p] + s, count))
                held += len(a)
            pieces.clear(), keys.clear(), offsets.clear()
            size = 0

        for batch in it:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                data = text.as_buffer()
                for at in range(0, max(1, len(data) - length + 1), PIECE):
                    if len(data) < length:
                        break
                    pieces.append(data[at : at + PIECE + length - 1])
                    keys.append(key), offsets.append(at)
                    size += len(pieces[-1])
                    if size >= PIECE:
                        close()
                        if held >= FLUSH:
                            yield _collapse(parts)
                            parts, held = [], 0
        if pieces:
            close()
        if parts:
            yield _collapse(parts)

    return run


def _fetch(length: int):
    @releasing
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: dict[str, list] = {"a": [], "key": [], "start": [], "bytes": []}
            held = 0
            for key, text, wanted in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                data = text.as_buffer()
                for w in wanted:
                    pos, count = w["place"] >> 16, w["place"] >> 1 & 0x7FFF
                    out["a"].append(w["a"]), out["key"].append(key), out["start"].append(pos)
                    out["bytes"].append(bytes(data[pos : pos + count - 1 + length]))
                held += sum(len(b) for b in out["bytes"][-len(wanted) :])
                if held >= 16 << 20:
                    yield pa.RecordBatch.from_pydict(out, _FETCHED)
                    out, held = {k: [] for k in out}, 0
            yield pa.RecordBatch.from_pydict(out, _FETCHED)

    return run


_FETCHED = pa.schema([("a", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])
_SPANS = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def suffix_order(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at `starts`, by group and then by their first `depth` bytes (at least 8), ties by start; and what each has in common with the one before, up to depth.

    Prefix doubling: ranks by 8, 16, 32, ... bytes. The common length is put together from those ranks, the longest
    first, and the last bytes one by one. A suffix has depth bytes at least; suffixes of two groups have nothing in common.
    """
    rank = np.zeros(len(data), np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    for i in range(8):
        rank = rank << np.uint64(8) | padded[i : i + len(data)]
    have, levels = 8, []
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint32)
    levels.append((8, rank))
    while 2 * have <= depth:
        both = rank.astype(np.uint64) << np.uint64(32) | rank[np.minimum(np.arange(len(data)) + have, len(data) - 1)]
        rank = np.unique(both, return_inverse=True)[1].astype(np.uint32)
        have *= 2
        levels.append((have, rank))
    last = rank[starts + (depth - have)]
    order = np.lexsort((starts, last, rank[starts], group))
    x, y, common = starts[order[:-1]], starts[order[1:]], np.zeros(max(0, len(order) - 1), np.int64)
    for width, level in reversed(levels):
        open_ = common + width <= depth
        common += width * (open_ & (level[np.where(open_, x + common, 0)] == level[np.where(open_, y + common, 0)]))
    for _ in range(7):
        open_ = common < depth
        common += open_ & (data[np.where(open_, x + common, 0)] == data[np.where(open_, y + common, 0)])
    # what the widths do not add up to: equal ranks by `have` bytes at both ends are equal depths
    common[(rank[x] == rank[y]) & (last[order[:-1]] == last[order[1:]])] = depth
    common[group[order[:-1]] != group[order[1:]]] = 0
    return order, np.concatenate((np.zeros(1, np.int64), common))[: len(order)]


def previous_smaller(value: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last place before it that holds a smaller value (-1 if none does), and the least of `common` on the way from there.

    All places at once: each points to the one before it; while it finds a larger value there it goes on to where that
    one points to, whose way is added to its own.
    """
    to, least = np.arange(len(value)) - 1, common.copy()
    open_ = np.flatnonzero(to >= 0)
    while len(open_ := open_[(to[open_] >= 0) & (value[to[open_]] > value[open_])]):
        via = to[open_]
        far, way = to[via], np.minimum(least[open_], least[via])
        to[open_], least[open_] = far, way
    least[to < 0] = 0
    return to, least


def longest_previous_factor(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """For each start the longest string, up to depth bytes, that begins there and at an earlier start of its group: the longer of what it shares with the previous and the next smaller start in suffix order."""
    order, common = suffix_order(data, starts, group, depth)
    at = starts[order]
    _, before = previous_smaller(at, common)
    # the same from the other end; there, what lies between two places is listed at the earlier one
    _, after = previous_smaller(at[::-1], np.concatenate((common[1:], common[:1] * 0))[::-1])
    out = np.zeros(len(starts), np.int64)
    out[order] = np.maximum(before, after[::-1])
    return out


def repeated_windows(slices: list[bytes], group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For slices in corpus order within their groups: slice number and offset of each window that starts earlier, too."""
    lens = np.array([len(s) for s in slices])
    data = np.frombuffer(b"".join(slices), np.uint8)
    begin = np.cumsum(lens) - lens
    counts = lens - length + 1
    number = np.repeat(np.arange(len(slices)), counts)
    offset = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
    lpf = longest_previous_factor(data, begin[number] + offset, group[number], length)
    found = np.flatnonzero(lpf >= length)
    return number[found], offset[found]


def _judge(length: int):
    def spans(slices: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        a, key, start = (np.array([s[i] for s in slices], np.int64) for i in range(3))
        number, offset = repeated_windows([s[3] for s in slices], a, length)
        new = np.concatenate(([True], (number[1:] != number[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(number) else np.empty(0, bool)
        last = np.concatenate((new[1:], [True])) if len(number) else new
        first, final = start[number[new]] + offset[new], start[number[last]] + offset[last] + length
        return pa.RecordBatch.from_arrays([pa.array(key[number[new]]), pa.array(first), pa.array(final)], schema=_SPANS)

    @releasing
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in it:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size >= 1 << 19 and row[0] != held[-1][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield spans(held)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs: key, text (binary). Returns spans (key, start, stop) of bytes to remove; they may overlap."""
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} at least")
    rows = docs.mapInArrow(_slices(length), "a long, c long, key long, place long")
    equal, shared = Window.partitionBy("a", "c").orderBy("key", "place"), Window.partitionBy("a")
    rows = rows.withColumn("first", F.row_number().over(equal) == 1)
    rows = rows.withColumn("kinds", F.sum(F.col("first").cast("int")).over(shared))
    rows = rows.withColumn("copy", ~F.col("first") | (F.col("place").bitwiseAND(1) == 1))
    rows = stage(rows.where("copy OR kinds > 1").select("a", "key", "place", "copy"), "slices")
    count = F.shiftright("place", 1).bitwiseAND(0x7FFF)
    start = F.shiftright("place", 16)
    copies = rows.where("copy").select("key", start.alias("start"), (start + count - 1 + length).alias("stop"))
    wanted = rows.where("NOT copy").groupBy("key").agg(F.collect_list(F.struct("a", "place")).alias("wanted"))
    fetched = docs.join(wanted, "key").select("key", "text", "wanted").mapInArrow(_fetch(length), "a long, key long, start long, bytes binary")
    judged = fetched.repartition("a").sortWithinPartitions("a", "key", "start").mapInArrow(_judge(length), "key long, start long, stop long")
    return copies.union(judged)


def _cut(with_bytes: bool):
    @releasing
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                data = text.as_buffer() if text.is_valid else b""
                n, runs, kept, at = len(data), 0, [], 0
                last = -1
                for s in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if s[0] > last:
                        runs += 1
                        kept.append(data[at : s[0]])
                    last = at = max(last, s[1])
                kept.append(data[at:])
                digest = hashlib.sha256()
                for k in kept:
                    digest.update(k)
                row = {"n_bytes": n, "n_removed": n - sum(len(k) for k in kept), "n_spans": runs, "kept_sha256": digest.hexdigest()}
                out.append(row | ({"kept": b"".join(bytes(k) for k in kept)} if with_bytes else {}))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes]
            cols = [pa.array([r[c] for r in out], pa.string() if c == "kept_sha256" else pa.binary() if c == "kept" else pa.int64()) for c in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], names=["doc_id", *names])

    return run


def dedup(docs: DataFrame, length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) for each document."""
    d, _ = keyed(docs.select("doc_id", "text"))
    d = d.select("doc_id", F.col("_key").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    spans = repeated_spans(d.select("key", "text"), length)
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return d.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_cut(with_bytes), schema)
