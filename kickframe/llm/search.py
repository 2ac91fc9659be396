"""Ranked lexical search: Block-Max MaxScore over shards of compressed postings.

The index is a table of shards. A shard holds the postings of some megabytes of text:
per term a list of documents in ascending order, cut into blocks of 128 that are
compressed as variable-length bytes. A block keeps, uncompressed, its last document and
the pairs (occurrences, document length) that no other pair of the block beats; so its
greatest possible share of a score is exact for whatever counts the whole corpus has,
and adding documents doesn't touch shards that are there.

A query takes lists in the order of their bounds. Lists whose bounds together can't
reach the tenth best score are non-essential: they are only asked about documents found
in the essential lists, and only in blocks whose maximum could still lift such a document
over the threshold. Other blocks are never decompressed. A task keeps one heap per query
over all its shards; the heaps of all tasks are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kickframe.llm.batches import freeing, small_batches, stage_arrow
from kickframe.session import stage

BLOCK, TOP = 128, 10
#: Text bytes of a shard; a longer document has a shard of its own.
SHARD = 8 << 20
#: Items asked at once and the most bytes of their terms: what a broadcast may hold.
ITEMS, ITEM_BYTES = 4000, 8 << 20
#: Lists that are opened between two looks at the threshold.
STEP = 8
_NO_ID = np.iinfo(np.int64).max
#: Everything in ASCII but letters and digits separates terms; A-Z are lowered.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = ("doc_ids binary, lengths binary, terms binary, sizes binary, last binary, at binary, points_at binary, "
         "point_tf binary, point_n binary, postings binary")
SCHEMA = pa.schema([(c.split()[0], pa.large_binary() if c.split()[0] == "postings" else pa.binary()) for c in INDEX.split(", ")])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of non-negative numbers below 2^35, and where each begins."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 5):
        size += v >= np.uint64(1 << 7 * k)
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        if not len(some):
            break
        part = (v[some] >> np.uint64(7 * k)) & np.uint64(127)
        out[begin[some] + k] = part.astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out, begin


def unpack(data: np.ndarray) -> np.ndarray:
    """The numbers of `pack`."""
    if not len(data):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(data < 128)
    begin = np.concatenate(([0], ends[:-1] + 1))
    value = (data[begin] & 127).astype(np.int64)
    for k in range(1, 5):
        more = np.flatnonzero(ends - begin >= k)
        if not len(more):
            break
        value[more] |= (data[begin[more] + k] & 127).astype(np.int64) << (7 * k)
    return value


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of many ranges, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


def scale(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """A document's m of its length, exactly."""
    if len(n) and int(n.max()) * 90 * documents >= 1 << 62:
        return np.array([100 - 90 + 90 * x * documents // words for x in n.tolist()], np.int64)
    return 100 - 90 + 90 * n.astype(np.int64) * documents // max(words, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def build(texts: list[tuple[int, bytes]]) -> dict[str, bytes]:
    """One shard of documents (id, text)."""
    names: dict[bytes, int] = {}
    ids, sizes, lengths, term, tf = [], [], [], [], []
    for doc, text in texts:
        words = terms_of(text)
        if not words:
            continue
        count = Counter(words)
        ids.append(doc)
        lengths.append(len(words))
        sizes.append(len(count))
        term.extend([names.setdefault(w, len(names)) for w in count])
        tf.extend(count.values())
    n = np.array(lengths, np.int64)
    term, tf = np.array(term, np.int64), np.array(tf, np.int64)
    doc = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(term, kind="stable")
    term, tf, doc = term[order], tf[order], doc[order]
    size = np.bincount(term, minlength=len(names))
    within = np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size)
    opens = within % BLOCK == 0
    first = np.flatnonzero(opens)
    block = np.cumsum(opens) - 1
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]  # a block can be read without the one before it
    both = np.empty(2 * len(doc), np.int64)
    both[0::2], both[1::2] = gap, tf
    data, begin = pack(both)
    ends = np.append(first[1:], len(doc)) - 1 if len(first) else first
    # What no other posting of the block beats: shorter documents first, more occurrences than any before.
    length = n[doc]
    if len(n) and n.max() >= 1 << 26 or len(first) >= 1 << 25:
        by = np.lexsort((-tf, length, block))
    else:
        by = np.argsort((block << 38) | (length << 12) | (4095 - np.minimum(tf, 4095)), kind="stable")
    height = (block[by] << 34) | tf[by]
    best = np.ones(len(by), bool)
    best[1:] = height[1:] > np.maximum.accumulate(height)[:-1]
    points = by[best]
    points_at = np.concatenate(([0], np.cumsum(np.bincount(block[points], minlength=len(first)))))
    return {
        "doc_ids": np.array([_NO_ID if d is None else d for d in ids], "<i8").tobytes(), "lengths": n.astype("<i8").tobytes(),
        "terms": b" ".join(names), "sizes": size.astype("<i4").tobytes(), "last": doc[ends].astype("<i4").tobytes(),
        "at": np.append(begin[2 * first] if len(first) else first, len(data)).astype("<i8").tobytes(),
        "points_at": points_at.astype("<i4").tobytes(), "point_tf": tf[points].astype("<i8").tobytes(),
        "point_n": length[points].astype("<i8").tobytes(), "postings": data.tobytes()}


def _indexed(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = text.as_py() or b""
                if held and size + len(text) > shard_bytes:
                    yield pa.RecordBatch.from_pylist([build(held)], SCHEMA)
                    held, size = [], 0
                held.append((doc, text))
                size += len(text)
        if held:
            yield pa.RecordBatch.from_pylist([build(held)], SCHEMA)
    return freeing(run)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, n))]), pa.array([int(sum(x.sum() for x in n))])], names=["documents", "words"])


@dataclass
class Queries:
    """A block of items: their distinct terms, and per item the numbers of its terms."""

    terms: dict[bytes, int]
    items: list[np.ndarray]
    weight: np.ndarray | None = None
    documents: int = 0
    words: int = 0


def _sizes(shared):
    """In how many documents of a task's shards each of the queries' terms is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.terms
        total = np.zeros(len(number), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                size = np.frombuffer(batch.column("sizes")[row].as_buffer(), "<i4")
                for i, t in enumerate(batch.column("terms")[row].as_py().split()):
                    if t in number:
                        total[number[t]] += size[i]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "df"])
    return run


class Shard:
    """An index row, opened for one block of queries. `opened` counts decompressed blocks."""

    def __init__(self, row: dict, q: Queries):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, n = get("doc_ids", "<i8"), get("lengths", "<i8")
        size, self.at, self.last = get("sizes", "<i4").astype(np.int64), get("at", "<i8"), get("last", "<i4")
        self.postings = get("postings", np.uint8)
        self.m = scale(n, q.documents, q.words)
        blocks = -(-size // BLOCK)
        ends = np.cumsum(blocks)
        points_at = get("points_at", "<i4")
        each = impact(get("point_tf", "<i8"), scale(get("point_n", "<i8"), q.documents, q.words))
        self.highest = np.maximum.reduceat(each, points_at[:-1]) if len(points_at) > 1 else each
        tops = np.maximum.reduceat(self.highest, ends - blocks) if len(ends) else ends
        #: Per query term its first block, the one after its last, and the greatest share of any document.
        self.span, self.top = np.zeros((len(q.terms), 2), np.int64), np.zeros(len(q.terms), np.int64)
        for i, t in enumerate(row["terms"].split()):
            k = q.terms.get(t)
            if k is not None:
                self.span[k], self.top[k] = (ends[i] - blocks[i], ends[i]), tops[i]
        self.opened = 0

    def decode(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document numbers, shares of a score and the place in `blocks` of all their postings."""
        self.opened += len(blocks)
        size = self.at[blocks + 1] - self.at[blocks]
        data = self.postings[_spans(self.at[blocks], size)]
        whole = np.add.reduceat(data < 128, np.cumsum(size) - size) // 2  # postings in each
        values = unpack(data)
        steps, tf = np.cumsum(values[0::2]), values[1::2]
        starts = np.cumsum(whole) - whole
        docs = steps - np.repeat(np.where(starts > 0, steps[starts - 1], 0), whole)
        return docs, impact(tf, self.m[docs]), np.repeat(np.arange(len(blocks)), whole)

    def search(self, wanted: np.ndarray, weight: np.ndarray, threshold: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (by number) that may be among the best `top`, with their scores; none above `threshold` is missing, nor any equal to it."""
        wanted = wanted[(self.top[wanted] > 0) & (weight[wanted] > 0)]
        bound = weight[wanted] * self.top[wanted]
        order = np.argsort(bound, kind="stable")
        wanted, bound = wanted[order], bound[order]
        upto = np.cumsum(bound)  # what the lists up to here can give together
        scores = np.zeros(len(self.ids), np.int64)
        left = len(wanted)
        while left and upto[left - 1] >= threshold:
            lists = wanted[max(0, left - STEP):left]
            count = self.span[lists, 1] - self.span[lists, 0]
            docs, share, place = self.decode(_spans(self.span[lists, 0], count))
            self._add(scores, docs, share * weight[np.repeat(lists, count)[place]])
            left -= len(lists)
            if left and len(scores) > top:
                # Scores only grow, so the best so far are a lower bound of the best.
                threshold = max(threshold, int(np.partition(scores, -top)[-top]))
        found = np.flatnonzero(scores)
        rest = int(upto[left - 1]) if left else 0
        found = found[scores[found] + rest >= threshold]
        for i in range(left - 1, -1, -1):
            if not len(found):
                break
            term = wanted[i]
            low, high = self.span[term]
            at = np.searchsorted(self.last[low:high], found)
            within = at < high - low
            most = scores[found] + (int(upto[i - 1]) if i else 0)
            most[within] += weight[term] * self.highest[low + at[within]]
            keep = most >= threshold
            found, at, within = found[keep], at[keep], within[keep]
            blocks = np.unique(at[within]) + low
            if len(blocks):
                docs, share, _ = self.decode(blocks)
                hit = np.isin(docs, found, assume_unique=True)
                scores[docs[hit]] += share[hit] * weight[term]
        return found, scores[found]

    @staticmethod
    def _add(scores: np.ndarray, docs: np.ndarray, values: np.ndarray) -> None:
        if len(values) and int(values.max()) * len(values) < 1 << 53:  # exact as doubles
            scores += np.bincount(docs, weights=values, minlength=len(scores)).astype(np.int64)
        else:
            np.add.at(scores, docs, values)


def _found(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        empty = np.empty(0, np.int64)
        heaps = [(empty, empty)] * len(q.items)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, q)
                for i, wanted in enumerate(q.items):
                    ids, best = heaps[i]
                    docs, scores = shard.search(wanted, q.weight, int(best[-1]) if len(best) == top else 1, top)
                    if len(docs):
                        ids, best = np.concatenate((ids, shard.ids[docs])), np.concatenate((best, scores))
                        order = np.lexsort((ids, -best))[:top]
                        heaps[i] = ids[order], best[order]
        number = np.repeat(np.arange(len(heaps)), [len(h[0]) for h in heaps])
        ids, scores = (np.concatenate([empty, *[h[k] for h in heaps]]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], names=["item", "doc_id", "score"])
    return run


class Index:
    """Shards of `documents` as a table, and the counts of the whole corpus."""

    def __init__(self, shards: DataFrame):
        self.shards = shards
        with small_batches(shards.sparkSession, 16):
            row = shards.select("lengths").mapInArrow(_totals, "documents long, words long").agg(F.sum("documents"), F.sum("words")).first()
        self.documents, self.words = row[0] or 0, row[1] or 0

    @classmethod
    def write(cls, docs: DataFrame, shard_bytes: int = SHARD) -> Index:
        return cls(stage_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_indexed(shard_bytes), INDEX), "shards"))

    def _weighted(self, q: Queries) -> Queries:
        shared = self.shards.sparkSession.sparkContext.broadcast(q)
        with small_batches(self.shards.sparkSession, 4):
            counts = self.shards.select("terms", "sizes").mapInArrow(_sizes(shared), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
            df = np.zeros(len(q.terms), np.int64)
            for r in counts.collect():  # at most a row per term of this block of items
                df[r.term] = r.df
        q.weight = np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        q.documents, q.words = self.documents, self.words
        return q

    def search(self, items: DataFrame, top: int = TOP, most_items: int = ITEMS, most_bytes: int = ITEM_BYTES) -> DataFrame:
        """The best `top` documents per item: `item_id`, `rank`, `doc_id`, `score`.

        Items without terms, and all items of an empty index, have no rows. Items that share an id are
        answered one by one. A document without an id comes after others of its score. Documents
        without terms are found by nothing.
        """
        spark = items.sparkSession
        out, number = None, 0
        for ids, q in self._blocks(items, most_items, most_bytes):
            shared = spark.sparkContext.broadcast(self._weighted(q))
            with small_batches(spark, 1):
                best = stage(self.shards.mapInArrow(_found(shared, top), "item int, doc_id long, score long"), "heaps")
            shared.unpersist()
            names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
            rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
            part = best.withColumn("rank", rank).where(F.col("rank") <= top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
            out = part if out is None else out.unionAll(part)
            number += len(ids)
        if out is None:
            kind = items.schema["item_id"].dataType.simpleString()
            return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
        return out

    @staticmethod
    def _blocks(items: DataFrame, most_items: int, most_bytes: int) -> Iterator[tuple[list, Queries]]:
        """Items in blocks of bounded size; one item alone may be larger."""
        ids, q, size = [], Queries({}, []), 0
        for row in items.select("item_id", "text").toLocalIterator():
            wanted = set(terms_of((row.text or "").encode()))
            if not wanted:
                continue
            more = sum(map(len, wanted)) + 8 * len(wanted)
            if ids and (len(ids) >= most_items or size + more > most_bytes):
                yield ids, q
                ids, q, size = [], Queries({}, []), 0
            ids.append(row.item_id)
            q.items.append(np.array(sorted(q.terms.setdefault(t, len(q.terms)) for t in sorted(wanted)), np.int64))
            size += more
        if ids:
            yield ids, q
