"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard.

Two permutations of the 32-bit hash space make all coordinates of a signature:
the first scatters the shingles, the second, shifted circularly by k, ranks them
for coordinate k. Documents that agree on a band are candidates and share a bucket.

The most central document of a bucket is its hub. Every member is confirmed against
its hubs on full shingle sets. What is then unconnected within the stars of a hub
is compared with all of them, in blocks, and each block gives back only the
links that join components. So connections are complete, while a large group of
near copies never becomes a list of pairs. Documents with equal sets are one class
from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm.batches import by_weight, claim, stage_arrow, text_bytes
from kickframe.llm.components import components
from kickframe.session import stage

#: 28 bands of four: a pair at exactly 0.8 is missed with probability (1 - 0.8^4)^28 < 4e-7.
BANDS, ROWS = 28, 4
#: Documents on either side of one comparison.
BLOCK = 512
_KNOWN_MAX = 300_000


class _Words(dict):
    """64-bit hash per word, kept per worker and emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_words = _Words()


def _mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    Letters A-Z count as lower case, words end at ASCII white space. A text with
    fewer words than a shingle has its whole sequence as the only one.
    """
    claim("minhash", _words.clear)
    if len(_words) > _KNOWN_MAX:
        _words.clear()
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    flat = np.fromiter((_words[w] for s in split for w in s), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    rolled = np.full(max(len(flat) - words + 1, 0), words, dtype=np.uint64)
    for i in range(words):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + flat[i:i + len(rolled)]
    rolled = _mix64(rolled)
    out = []
    for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        if n >= words:
            own = np.sort(rolled[end - n:end - words + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif n:
            h = np.full(1, n, dtype=np.uint64)
            for w in flat[end - n:end]:
                h = h * np.uint64(0xD6E8FEB86659FD93) + w
            out.append(_mix64(h))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: a row of 32-bit minima per set."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), coordinates), np.uint32)
    for part in by_weight(sizes, 1 << 15):
        scattered = (_mix64(np.concatenate(sets[part]) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum(sizes[part])[:-1]))
        y, t = np.empty_like(scattered), np.empty_like(scattered)
        for k in range(coordinates):
            np.add(scattered, np.uint32(k), out=y)  # the circular shift
            np.right_shift(y, 16, out=t)
            np.bitwise_xor(y, t, out=y)
            np.multiply(y, np.uint32(0x7FEB352D), out=y)
            np.right_shift(y, 15, out=t)
            np.bitwise_xor(y, t, out=y)
            np.multiply(y, np.uint32(0x846CA68B), out=y)
            np.right_shift(y, 16, out=t)
            np.bitwise_xor(y, t, out=y)
            out[part, k] = np.minimum.reduceat(y, starts)
    return out


def _bands(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grouped = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), grouped.shape[:2])
    for i in range(rows):
        key = _mix64(key * np.uint64(0xD6E8FEB86659FD93) + grouped[:, :, i])
    return key.view(np.int64)


def _sketched(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for part in by_weight(np.array([len(t) for t in texts]), 1 << 21):
                sets = shingle_sets(texts[part], words)
                full = [i for i, s in enumerate(sets) if len(s)]
                signature = signatures([sets[i] for i in full], bands * rows) if full else np.empty((0, bands * rows), np.uint32)
                keys = _bands(signature, bands, rows)
                at = {i: j for j, i in enumerate(full)}
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[part], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([keys[at[i]] if i in at else None for i in range(len(sets))], pa.list_(pa.int64())),
                    pa.array([signature[at[i]].tobytes() if i in at else None for i in range(len(sets))], pa.binary()),
                ], names=["doc_id", "n_shingles", "set_key", "bands", "signature"])
    return run


def _shared(x: np.ndarray, shingles: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Size of the intersection of `x` with each of n sets, given as sorted shingles and their owners."""
    lo, hi = np.searchsorted(shingles, x, "left"), np.searchsorted(shingles, x, "right")
    length = hi - lo
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return np.bincount(owner[np.repeat(lo, length) + inner], minlength=n)


def _similar(shared, n, m, percent: int):
    return 100 * shared >= percent * (n + m - shared)


def _stars(words: int, percent: int):
    """Confirm members against their hub; rows of a hub (and part) begin with the hub itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            hubs, docs = batch.column("hub").to_pylist(), batch.column("doc_id").to_pylist()
            texts = text_bytes(batch.column("text"))
            a, b = [], []
            for part in by_weight(np.array([len(t) for t in texts]), 1 << 21):
                for h, d, s in zip(hubs[part], docs[part], shingle_sets(texts[part], words), strict=True):
                    if d == h:
                        hub, own = h, s
                    elif _similar(len(np.intersect1d(own, s, assume_unique=True)), len(own), len(s), percent):
                        a.append(hub)
                        b.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _joining(words: int, percent: int):
    """Links between the left and the right block of a hub that join components."""
    def run(table: pa.Table) -> pa.Table:
        left_side = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        docs = table.column("doc_id").to_numpy()
        names, root = np.unique(table.column("component").to_numpy(), return_inverse=True)
        texts, sets = text_bytes(table.column("text").combine_chunks()), []
        for part in by_weight(np.array([len(t) for t in texts]), 1 << 21):
            sets += shingle_sets(texts[part], words)
        size = np.array([len(s) for s in sets])
        right = np.flatnonzero(~left_side)
        owner = np.repeat(np.arange(len(right)), size[right])
        shingles = np.concatenate([sets[i] for i in right]) if len(right) else np.empty(0, np.uint64)
        order = np.argsort(shingles, kind="stable")
        shingles, owner = shingles[order], owner[order]
        a, b = [], []
        for i in np.flatnonzero(left_side).tolist():
            if (root[right] == root[i]).all():
                continue
            good = _similar(_shared(sets[i], shingles, owner, len(right)), size[i], size[right], percent)
            for j in right[good & (root[right] != root[i])].tolist():
                if root[j] != root[i]:
                    a.append(docs[i])
                    b.append(docs[j])
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


class _Search:
    """State of one search; every attribute is a table in the shared folder."""

    def __init__(self, docs: DataFrame, words: int, percent: int, bands: int, rows: int):
        self.words, self.percent, self.bands, self.rows = words, percent, bands, rows
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.sketches = stage_arrow(self.texts.mapInArrow(
            _sketched(words, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>, signature binary"), "sketches")
        named = self.sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
        self.copies = stage(named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
                            .where("c > 1").select("set_key", "rep"), "copies")
        #: One document per distinct set. Joins with all documents are shuffled at any size, so that plans grow evenly.
        self.classes = named.join(self.copies.hint("merge"), "set_key", "left").where("rep IS NULL OR rep = doc_id")

    def members(self) -> DataFrame:
        """Buckets with two classes or more: (`bucket`, `doc_id`, `n`, `size`, `rank`)."""
        rows = self.classes.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        shared = stage(rows.join(sizes.hint("merge"), "bucket"), "members")
        degree = shared.groupBy("doc_id").agg(F.sum(F.col("size") - 1).alias("rank"))
        return stage(shared.join(degree, "doc_id"), "members")

    def stars(self) -> DataFrame:
        """Hubs with the documents that share a bucket of theirs: (`hub`, `doc_id`, `fit`); the hub is one of them.

        `fit`: the sizes of both sets allow the similarity.
        """
        members = self.members()
        top = members.groupBy("bucket").agg(F.max(F.struct("rank", (-F.col("doc_id")).alias("neg"), "n")).alias("top"))
        hubs = top.select("bucket", (-F.col("top.neg")).alias("hub"), F.col("top.n").alias("hub_n"))
        fit = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * self.percent
        return stage(members.join(hubs, "bucket").select("hub", "doc_id", fit.alias("fit")).distinct(), "stars")

    def links(self) -> DataFrame:
        """Enough confirmed links to connect what is connected."""
        stars = self.stars()
        ids = stars.select(F.col("doc_id").alias("id")).distinct()
        texts = stage(self.texts.join(ids.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi"), "candidates")
        # A star is cut into parts, each with its hub, so that a large one is shared out.
        counts = stars.groupBy("hub").agg(F.count("*").alias("n"))
        parts = F.ceil(F.col("n") / F.lit(4 * BLOCK)).cast("int")
        own = F.pmod(F.xxhash64("doc_id"), parts).cast("int")
        rows = stars.where("fit").join(counts, "hub").withColumn("part", F.explode(
            F.when(F.col("hub") == F.col("doc_id"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))))
        rows = rows.select("hub", "part", "doc_id").join(texts.hint("merge"), "doc_id").repartition("hub", "part").sortWithinPartitions(
            "hub", "part", F.col("doc_id") != F.col("hub"))
        links = stage_arrow(rows.mapInArrow(_stars(self.words, self.percent), "a long, b long"), "links")
        more = self.joining(stars, texts, components(links))
        return links.unionByName(more)

    def joining(self, stars: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
        """Links that stars have left out: in each, whatever lies outside its largest component against all its members."""
        known = stars.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        known = stage(known.select("hub", "doc_id", F.coalesce("component", "doc_id").alias("component")), "labelled")
        sizes = known.groupBy("hub", "component").agg(F.count("*").alias("c"))
        core = sizes.groupBy("hub").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("n"))
        # Two members have met already.
        core = core.where("n > 2 AND top.c < n").select("hub", F.col("top.component").alias("core"), "n", (F.col("n") - F.col("top.c")).alias("outside"))
        rows = known.join(core, "hub")
        across, down = (F.ceil(F.col(c) / F.lit(BLOCK)).cast("int") for c in ("n", "outside"))
        at = F.xxhash64("doc_id")
        outer = F.transform(F.sequence(F.lit(0), across - 1), lambda j: F.struct(F.lit(True).alias("left"), F.pmod(at, down).cast("int").alias("i"), j.alias("j")))
        inner = F.transform(F.sequence(F.lit(0), down - 1), lambda i: F.struct(F.lit(False).alias("left"), i.alias("i"), F.pmod(at, across).cast("int").alias("j")))
        rows = rows.withColumn("item", F.explode(F.when(F.col("component") != F.col("core"), F.concat(outer, inner)).otherwise(inner)))
        rows = rows.select("hub", "item.*", "doc_id", "component").join(texts.hint("merge"), "doc_id")
        return rows.groupBy("hub", "i", "j").applyInArrow(_joining(self.words, self.percent), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of `docs`: `doc_id`, `n_shingles`, `component_id`, `kept`.

    Two documents are linked when 100 * shared >= `percent` * united shingles of
    `words` words. The component is the smallest id reachable by links. Null and
    empty texts, and texts of white space, have no shingles and no links. Rows with
    a null id have none either and are kept. An id that several rows carry is one
    document as to links. An empty table gives no rows.
    """
    search = _Search(docs, words, percent, bands, rows)
    links = search.links()
    same = (search.sketches.where("doc_id IS NOT NULL").join(search.copies, "set_key")
            .where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(links.unionByName(same))
    out = search.sketches.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedupe(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without all but the first of each group, all columns kept."""
    found = near_duplicates(docs, words, percent)
    lost = stage(found.where("NOT kept").select(F.col("doc_id").alias("__lost")).distinct(), "dropped")
    return docs.join(lost, docs["doc_id"] == lost["__lost"], "left_anti")
