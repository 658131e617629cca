"""Repeated byte strings over a whole corpus, by a sparse enhanced suffix array.

A string of ``LENGTH`` bytes holds at least one anchor: the position of the
smallest ``SEED``-byte digest in it. Equal strings hold equal anchors at equal
places, so only suffixes that start at anchors are ordered (less than one byte
position in a hundred). The places of an anchor in its string fall into ranges;
strings of one range share a core around the anchor, and only cores that occur at
least twice go on. Within a core's group Spark orders the suffixes behind the core;
a stack scan over their common prefixes visits the interval tree, and the left
extensions in each interval decide which of them repeat as a whole. That gives
every occurrence its longest repeat to both sides, hence all covered bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import sized_broadcast, stored
from riskloom.llm.text import scrambled

LENGTH = 400
SEED = 64
#: Members of a core's group that are ordered in one task; a larger group is cut by finer ranges first.
GROUP = 512
#: Bytes of a text that are digested at a time.
CHUNK = 1 << 20
#: Text keys that are broadcast (16 bytes each); more are joined by a shuffle.
KEYS_SENT = 1_000_000
PARTS = 4


def split_range(lo: int, hi: int) -> list[tuple[int, int]]:
    """The places lo..hi in up to four runs."""
    n = hi - lo + 1
    cuts = [lo + n * i // PARTS for i in range(PARTS + 1)]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


RANGES = split_range(0, LENGTH - SEED)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class _Digester:
    """Digests of all substrings of a chunk from one running sum."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)

    def load(self, raw: np.ndarray) -> None:
        if len(raw) + 1 > len(self.up):
            self.up, self.down = _powers(_BASE, 2 * len(raw) + 2), _powers(_INVERSE, 2 * len(raw) + 2)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        return scrambled((self.sums[start + length] - self.sums[start]) * self.down[start] + np.uint64(length))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return scrambled((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(length))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every run of ``width`` values, in linear time."""
    n = len(values) - width + 1
    fill = np.iinfo(np.uint64).max if pick is np.minimum else 0
    pad = -len(values) % width
    rows = np.concatenate([values, np.full(pad, fill, np.uint64)]).reshape(-1, width)
    ahead = pick.accumulate(rows, axis=1).ravel()
    behind = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray, digester: _Digester) -> tuple[np.ndarray, np.ndarray]:
    """Positions and seed digests of the anchors of a chunk whose digests are loaded."""
    if len(raw) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    seeds = digester.all(SEED)
    width = LENGTH - SEED + 1
    lowest = _sliding(seeds, width, np.minimum)
    # A seed is an anchor if it is the smallest of some string that holds it.
    edge = np.zeros(width - 1, np.uint64)
    best = _sliding(np.concatenate([edge, lowest, edge]), width, np.maximum)
    at = np.flatnonzero(seeds == best)
    return at, seeds[at]


def _chunks(raw: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, last, base): own positions first..last of a chunk that is read from base on, with margins."""
    for first in range(0, max(len(raw), 1), CHUNK):
        yield first, min(first + CHUNK, len(raw)), max(0, first - 2 * LENGTH)


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digester = _Digester()
    for batch in batches:
        for text, key in zip(batch.column("raw"), batch.column("print"), strict=True):
            value = text.as_py()
            raw = np.frombuffer(value or b"", np.uint8)
            if len(raw) < LENGTH:
                continue
            for first, last, base in _chunks(raw):
                piece = raw[base : last + 2 * LENGTH]
                digester.load(piece)
                at, seeds = anchors(piece, digester)
                own = (at + base >= first) & (at + base < last)
                at, seeds = at[own], seeds[own]
                cores = []
                for lo, hi in RANGES:
                    start, size = at - lo, LENGTH - (hi - lo)
                    there = (start >= 0) & (start + size <= len(piece))
                    core = np.zeros(len(at), np.uint64)
                    core[there] = digester.of(start[there], size)
                    cores.append(pa.array(core.view(np.int64), mask=~there))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(at), pa.binary()), pa.array(at + base, pa.int64()),
                     pa.array(seeds.view(np.int64)), *cores],
                    names=["print", "pos", "seed", *(f"c{i}" for i in range(len(RANGES)))],
                )


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that may extend each live core to both sides."""
    for batch in batches:
        for raw_, key, live in zip(batch.column("raw"), batch.column("print"), batch.column("live"), strict=True):
            raw = raw_.as_py()
            rows = []
            for x in live.as_py():
                lo, hi = RANGES[x["part"]]
                start, end = x["pos"] - lo, x["pos"] - lo + LENGTH - (hi - lo)
                rows.append((x["n"], x["core"], start, end, hi - lo, raw[max(0, start - (hi - lo)) : start], raw[end : end + hi - lo]))
            n, core, start, end, room, left, right = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int64()), pa.array(core, pa.int64()), pa.array([key.as_py()] * len(rows), pa.binary()), pa.array(start, pa.int64()),
                 pa.array(end, pa.int64()), pa.array(room, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                names=["n", "core", "print", "start", "end", "room", "left", "right"],
            )


#: ``n`` is an upper bound of the number of members of the core's group.
MEMBERS = "n bigint, core bigint, print binary, start bigint, end bigint, room int, left binary, right binary"


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def longest_repeats(lefts: list[bytes], rights: list[bytes], room: int) -> list[tuple[int, int] | None]:
    """For each member of a group, how far its repeats reach to the left and right of the core.

    ``rights`` are in order; ``lefts`` are given backwards from the core. Two
    members repeat a string of full length if their common extensions to both
    sides add up to ``room``. The stack holds the open intervals of the prefix
    tree of ``rights``; an interval closes with all its members, whose left
    extensions of at least ``room - depth`` bytes must agree with another member's.
    """
    n = len(rights)
    reach: list[tuple[int, int] | None] = [None] * n

    def close(first: int, last: int, depth: int) -> None:
        least = room - depth
        order = sorted(range(first, last + 1), key=lefts.__getitem__)
        shared = [0, *(common(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)), 0]
        for k, i in enumerate(order):
            # Neighbours in order share most; the ends of the interval share nothing.
            left = max(shared[k] if k else -1, shared[k + 1] if k + 1 < len(order) else -1)
            if left >= least:
                old = reach[i] or (0, 0)
                reach[i] = (max(old[0], left), max(old[1], depth))

    stack: list[tuple[int, int]] = []
    for i in range(1, n + 1):
        depth = common(rights[i - 1], rights[i]) if i < n else -1
        first = i - 1
        while stack and stack[-1][1] > depth:
            first, inner = stack.pop()
            close(first, i - 1, inner)
        if depth >= 0 and (not stack or stack[-1][1] < depth):
            stack.append((first, depth))
    return reach


def _group_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of the members of each group; rows come ordered by core, then by suffix."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("core", "print", "start", "end", "room", "left", "right")), strict=True)

    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        keys, starts, ends = zip(*out, strict=True) if out else ((), (), ())
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["print", "start", "end"]
        )

    for _, group in groupby(rows(), key=lambda r: r[0]):
        members = [next(same) for _, same in groupby(group, key=lambda r: (r[6], r[1], r[2]))]
        if len(members) > 1:
            lefts = [r[5][::-1] for r in members]
            for r, reach in zip(members, longest_repeats(lefts, [r[6] for r in members], members[0][4]), strict=True):
                if reach is not None:
                    out.append((r[1], r[2] - reach[0], r[3] + reach[1]))
        if len(out) >= 10_000:
            yield flushed()
    yield flushed()


def _finer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of large groups again, by finer ranges of places, which share longer cores."""
    for batch in batches:
        rows = []
        for core, key, start, end, room, left, right in zip(*(batch.column(c).to_pylist() for c in ("core", "print", "start", "end", "room", "left", "right")), strict=True):
            for lo, hi in split_range(0, room):
                more = room - hi
                if lo <= len(left) and more <= len(right):
                    inner = left[len(left) - lo :], right[:more]
                    own = hashlib.blake2b(b"%d %d %d " % (core, lo, len(inner[0])) + b"".join(inner), digest_size=8).digest()
                    rows.append(
                        (0, int.from_bytes(own, "little", signed=True), key, start - lo, end + more, hi - lo,
                         left[: len(left) - lo][lo - hi :] if hi > lo else b"", right[more : more + hi - lo])
                    )
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["n", "core", "print", "start", "end", "room", "left", "right"],
        )


def _repeated(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, n) of the keys that occur at two different places; copies of a text are one place.

    A table of its own, so that the join with it may split a key that very many rows have.
    """
    place = F.xxhash64("print", "pos")
    counted = rows.groupBy(key).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n"))
    return stored(counted.where("low <> high").select(key, "n"), label)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(print, start, end) of byte ranges that repeat, for ``texts(id, print, raw)``; ranges may overlap.

    Copies of one text count as one text here: what a text shares with its own
    copies is known without looking at it.
    """
    found = stored(
        texts.select("print", "raw").mapInArrow(
            _anchor_batches, "print binary, pos bigint, seed bigint, " + ", ".join(f"c{i} bigint" for i in range(len(RANGES)))
        ),
        "anchors",
    )
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.col(f"c{i}").alias("core")) for i in range(len(RANGES))])
    cores = (
        found.join(_repeated(found, "seed", "seeds").select("seed"), "seed")
        .select("print", "pos", F.inline(parts))
        .where("core is not null")
        .withColumn("core", F.xxhash64("core", "part"))
    )
    cores = stored(cores, "cores")
    live = cores.join(_repeated(cores, "core", "core-sizes"), "core")
    live = stored(live.groupBy("print").agg(F.collect_set(F.struct("pos", "part", "core", "n")).alias("live")), "live")
    # One text per print gives the contexts.
    heads = texts.groupBy("print").agg(F.min("id").alias("head"))
    heads = stored(live.select("print").join(heads, "print"), "heads")
    few = texts.join(sized_broadcast(heads.withColumnRenamed("print", "p"), KEYS_SENT), F.expr("print = p and id <=> head"))
    members = few.select("print", "raw").join(live, "print").select("print", "raw", "live").mapInArrow(_context_batches, MEMBERS)
    members, spans = stored(members, "members"), None
    while True:
        small = members.where(F.col("n") <= GROUP)
        part = small.repartition("core").sortWithinPartitions("core", "right", "print", "start")
        part = part.mapInArrow(_group_batches, "print binary, start bigint, end bigint")
        spans = part if spans is None else spans.unionByName(part)
        large = members.where(F.col("n") > GROUP)
        if large.isEmpty():
            return spans
        # Members that agree in all their bytes repeat as a whole; one of them stands for all from here on.
        place = F.struct("print", "start", "end")
        alike = large.groupBy("core", "left", "right", "room").agg(F.min(place).alias("m"), F.max(place).alias("last"))
        alike = stored(alike, "alike")
        whole = large.join(alike.where("m <> last").select("core", "left", "right"), ["core", "left", "right"])
        full = "length(left) + length(right) >= room"
        spans = spans.unionByName(
            whole.where(full).select("print", (F.col("start") - F.length("left")).alias("start"), (F.col("end") + F.length("right")).alias("end"))
        )
        rest = alike.select("core", "m.print", "m.start", "m.end", "room", "left", "right").where("room > 0")
        finer = stored(rest.mapInArrow(_finer_batches, MEMBERS), "finer")
        sizes = _repeated(finer.withColumnRenamed("start", "pos"), "core", "core-sizes")
        members = stored(finer.drop("n").join(sizes, "core"), "members")


def _removed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw_, spans_, whole in zip(batch.column("raw"), batch.column("spans"), batch.column("whole"), strict=True):
            raw = raw_.as_py() or b""
            spans = sorted((s["start"], s["end"]) for s in spans_.as_py() or [])
            if whole.as_py() and len(raw) >= LENGTH:
                spans = [(0, len(raw))]
            kept, at, removed, runs = hashlib.sha256(), 0, 0, 0
            own: list[list[int]] = []
            for start, end in spans:
                # Runs that touch are one run.
                if own and start <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], end)
                else:
                    own.append([start, end])
            for start, end in own:
                kept.update(raw[at:start])
                removed, runs, at = removed + end - start, runs + 1, end
            kept.update(raw[at:])
            rows.append((len(raw), removed, runs, kept.hexdigest(), own))
        sizes, removed, runs, digests, spans = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
             pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    ``spans`` are the removed byte ranges [start, end). A byte goes if a string of
    ``LENGTH`` bytes that covers it also starts anywhere else, in this text or
    another; repeated rows count as occurrences. Null texts are empty and keep
    nothing; texts below ``LENGTH`` bytes keep everything. Other columns are not
    read. Groups of any size are complete: large ones are cut by finer ranges.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))
    texts = texts.withColumn("print", F.unhex(F.md5("raw")))
    spans = repeated_spans(texts).groupBy("print").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    copies = texts.groupBy("print").agg(F.count("*").alias("n"))
    known = copies.where("n > 1").select("print", F.lit(True).alias("whole")).join(spans, "print", "full")
    joined = texts.join(known, "print", "left").select("id", "raw", "spans", F.coalesce("whole", F.lit(False)).alias("whole"))
    out = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>"
    return joined.mapInArrow(_removed_batches, out).withColumnRenamed("id", id_col)
