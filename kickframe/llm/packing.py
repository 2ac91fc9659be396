"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Only the count of pieces per length matters for a plan, and lengths are bounded
by the capacity, so the plan is made on a histogram of at most that many numbers,
whatever the size of the corpus. The reduction fixes sets that provably dominate
every other set holding the longest open piece; best fit places the rest. A plan
is a list of patterns with multiplicities. Pieces meet their places by rank within
their length: each task numbers its own, and a small table of counts per task and
length makes the numbers global, so no length is ever sorted or gathered.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kickframe.llm.batches import by_weight, freeing, stage_arrow, utf8_lengths
from kickframe.llm.files import opened, put
from kickframe.llm.tokens import encoder
from kickframe.session import scratch_path, stage

CAPACITY = 4096
#: Words of a generation in a worker: beside what a pipeline's earlier stages left, less memory counts more than time.
KEPT = 150_000


class _Lengths:
    """Multiset of lengths with the queries that the reduction asks."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: n for k, n in counts.items() if n > 0}
        self.keys = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.keys.pop(bisect.bisect_left(self.keys, length))

    def give(self, length: int) -> None:
        if length not in self.counts:
            bisect.insort(self.keys, length)
        self.counts[length] = self.counts.get(length, 0) + 1

    def largest(self, room: int) -> int:
        """The greatest length that fits, 0 if none."""
        i = bisect.bisect_right(self.keys, room)
        return self.keys[i - 1] if i else 0

    def smallest_three(self) -> list[int]:
        out: list[int] = []
        for k in self.keys[:3]:
            out += [k] * min(3 - len(out), self.counts[k])
        return out

    def best_pair(self, room: int) -> tuple[int, int]:
        """Two pieces with the greatest sum that fits, (0, 0) if none."""
        best, lo, hi = (0, 0), 0, bisect.bisect_right(self.keys, room) - 1
        while lo <= hi:
            a, b = self.keys[lo], self.keys[hi]
            if a + b > room or (lo == hi and self.counts[a] < 2):
                hi -= 1
                continue
            if a + b > sum(best):
                best = (a, b)
            lo += 1
        return best


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Sets that may be fixed without loss, with multiplicities, and what is left.

    Pieces are tried from the longest down. A piece alone, if nothing
    fits beside it; with the greatest partner, if that fills the sequence or no two
    others fit; with that partner also if no two fitting pieces together exceed it.
    """
    open_, fixed = _Lengths(counts), []
    for top in sorted(counts, reverse=True):
        while n := open_.counts.get(top, 0):
            room = capacity - top
            open_.take(top, 1)  # the piece in question; the rest are its possible partners
            partner, small, pair = open_.largest(room), open_.smallest_three(), None
            two = len(small) >= 2 and small[0] + small[1] <= room
            if two and partner != room and not (len(small) == 3 and sum(small) <= room):
                pair = open_.best_pair(room)
            open_.give(top)
            if not partner:
                fixed.append(([top], n))
                open_.take(top, n)
            elif partner == room or not two or (pair and sum(pair) <= partner):
                # It holds again while both lengths last: fewer pieces leave fewer rivals.
                times = n // 2 if partner == top else min(n, open_.counts[partner])
                fixed.append(([top, partner], times))
                open_.take(top, times)
                open_.take(partner, times)
            else:
                break
    return fixed, open_.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit of pieces in descending length: patterns [(length, times)] and how many of each.

    Sequences with the same content are one group, so the work depends on the number
    of distinct lengths only.
    """
    groups: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: list[tuple[int, int]], n: int) -> None:
        if not groups[room]:
            bisect.insort(rooms, room)
        groups[room].append((pattern, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    put(capacity - each * length, [(length, each)], whole)
                if rest:
                    put(capacity - rest * length, [(length, rest)], 1)
                break
            room = rooms[i]
            pattern, m = groups[room].pop()
            if not groups[room]:
                rooms.pop(i)
            # A sequence that takes one piece is the tightest for the next one as well.
            each = min(room // length, n)
            used = min(m, n // each)
            put(room - each * length, [*pattern, (length, each)], used)
            if m > used:
                put(room, pattern, m - used)
            n -= used * each
    return [x for room in groups for x in groups[room]]


@dataclass
class Plan:
    """Places by (length, rank): a range of ranks of one length has consecutive sequences at one offset."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    times: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (self.length << 44) + self.rank
        i = np.searchsorted(key, (length << 44) + rank, side="right") - 1
        within = rank - self.rank[i]
        return self.sequence[i] + within // self.times[i], self.offset[i] + within % self.times[i] * length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The reduced instance's fixed sets and the best-fit patterns, as ranges of ranks."""
    fixed, left = reduce_dominated(counts, capacity)
    patterns = [([(s[0], 2)] if len(s) == 2 and s[0] == s[1] else [(x, 1) for x in s], m) for s, m in fixed]
    patterns += best_fit(left, capacity)
    ranks: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, m in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, ranks[length], sequence, offset, times))
            ranks[length] += m * times
            offset += length * times
        sequence += m
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequence)


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences: the greatest over thresholds of big pieces plus what exceeds their room."""
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in lengths.tolist()], np.int64)
    best = 0
    for k in [0, *lengths[lengths <= capacity // 2].tolist()]:
        big, mid, low = lengths > capacity - k, (lengths <= capacity - k) & (lengths > capacity // 2), (lengths <= capacity // 2) & (lengths >= k)
        room = int((n[mid] * (capacity - lengths[mid])).sum())
        best = max(best, int(n[big].sum() + n[mid].sum()) + max(0, -(-(int((n[low] * lengths[low]).sum()) - room) // capacity)))
    return best


def _cut(path: str, words: str, end: int, capacity: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task, seen = encoder(path, words, KEPT), TaskContext.get().partitionId(), defaultdict(int)
        tail = np.array([end], code.dtype).tobytes()
        width = code.dtype.itemsize
        last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
        for batch in batches:
            for part in by_weight(utf8_lengths(batch.column(1)), 1 << 20):
                texts = [t or "" for t in batch.column(1)[part].to_pylist()]
                ids = batch.column(0)[part].to_pylist()
                rows = []
                for doc, data in zip(ids, code.ids(texts), strict=True):
                    data += tail
                    for k, at in enumerate(range(0, len(data), capacity * width)):
                        piece = data[at:at + capacity * width]
                        n = len(piece) // width
                        rows.append((doc, k, at // width, n, checksum(piece, code.dtype) if digest else piece, task, seen[n]))
                        seen[n] += 1
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), last[1], pa.int32(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", last[0], "task", "nth"])
    return freeing(run)


def checksum(ids: bytes, dtype: np.dtype) -> int:
    """CRC-32 of ids as little-endian 32-bit numbers."""
    return zlib.crc32(np.frombuffer(ids, dtype).astype("<u4"))


def _kept_bases(folder: str):
    """Writes the bases of one task's pieces, a number per length, where those who read its pieces find them."""
    def run(table: pa.Table) -> pa.Table:
        task = table.column("task")[0].as_py()
        put(folder, str(task), np.stack([table.column(c).to_numpy().astype("<i8") for c in ("length", "base")]).tobytes())
        return pa.table({"task": pa.array([task], pa.int32())})
    return run


def _placed(plan_, folder: str, last: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bases = None, None
        for batch in batches:
            tasks, length, rank = (batch.column(c).to_numpy() for c in ("task", "length", "nth"))
            rank = rank.copy()
            for one in np.unique(tasks).tolist():
                if one != task:
                    with opened(folder, str(one)) as f:
                        known, base = np.frombuffer(f.read(), "<i8").reshape(2, -1)
                    task, bases = one, np.zeros(int(known.max()) + 1, np.int64)
                    bases[known] = base
                own = tasks == one
                rank[own] += bases[length[own]]
            sequence, offset = plan_.value.places(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "piece", "start", "length", last)], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", last, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, path: str, words: str = "none", end: int = 1, capacity: int = CAPACITY, digest: bool = False) -> DataFrame:
    """A row per piece: `doc_id`, `piece`, `start`, `length`, `ids`, `sequence_id`, `offset`.

    Texts are encoded by the tokenizers file `path` and end with `end`; null counts as
    empty. Documents longer than `capacity` are cut into full pieces and a rest. `ids`
    are little-endian, 16 bits wide where the vocabulary allows. Repeated rows are packed
    as often as they occur. An empty table gives no rows. With `digest` the ids stay in the task and
    `ids_crc32`, the checksum of their 32-bit form, takes their place. Pieces are written
    once and read once; ids are never shuffled.
    """
    spark = docs.sparkSession
    last, kind = ("ids_crc32", "long") if digest else ("ids", "binary")
    pieces = stage_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                         .mapInArrow(_cut(path, words, end, capacity, digest), f"doc_id long, piece int, start long, length long, {last} {kind}, task int, nth long"), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan_ = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    folder = scratch_path(spark, "bases")
    stage(bases.groupBy("task").applyInArrow(_kept_bases(folder), "task int"), "bases")  # at most `capacity` numbers a task
    return pieces.mapInArrow(_placed(plan_, folder, last), f"doc_id long, piece int, start long, length long, {last} {kind}, sequence_id long, offset long")
