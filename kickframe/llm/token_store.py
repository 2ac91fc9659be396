"""Token ids as binary shards with a minimal perfect hash index for access by document.

Shards hold the ids of documents in ascending order of their keys, back to back.
The index is cut into buckets by key hash; each bucket is one file with a minimal
perfect hash function (levels of collision-free bits, ranked) and a slot per key:
fingerprint, shard, first record, first id, number of ids, number of records.
A lookup reads a bit, a rank and a slot, whatever the size of the collection.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kickframe.llm.batches import by_weight, stage_arrow, utf8_lengths
from kickframe.llm.files import Attempt, opened
from kickframe.llm.tokens import encoder
from kickframe.session import stage

MAGIC, HEAD = b"KFTOKEN1", 16
BUCKET_KEYS = 50_000
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("record", "<u8"), ("start", "<u8"), ("n", "<u8"), ("copies", "<u4")])
DIRECTORY = "doc_id long, shard int, file string, record long, start long, n long"
#: Hash of a key that is null; other keys are hashed by a bijection.
NULL_HASH = 0x1F83D9ABFB41BD6B


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hashes(keys: pa.Array) -> np.ndarray:
    values = keys.cast(pa.int64())
    out = mix64(values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 1)
    out[values.is_null().to_numpy(zero_copy_only=False)] = np.uint64(NULL_HASH)
    return out


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit numbers."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.firsts = np.concatenate(([0], np.cumsum(sizes // 64)))

    @classmethod
    def build(cls, hashes: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        sizes, words, left = [], [], hashes
        while len(left):
            m = 64 * max(1, -(-int(gamma * len(left)) // 64))
            at = mix64(left, len(sizes) + 2) % np.uint64(m)
            alone = np.bincount(at.astype(np.int64), minlength=m) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(m)
            left = left[~alone[at]]
        flat = np.concatenate(words) if words else np.empty(0, "<u8")
        counts = np.bitwise_count(flat).astype(np.int64)
        return cls(np.array(sizes, np.int64), flat, np.cumsum(counts) - counts)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key; of a number that isn't a key, -1 or any slot."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, m in enumerate(self.sizes.tolist()):
            at = mix64(hashes[left], level + 2) % np.uint64(m)
            word = self.firsts[level] + (at >> np.uint64(6)).astype(np.int64)
            bit = at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.ranks[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes, 99) >> np.uint64(32)).astype(np.uint32)


def _written(folder: str, path: str, words: str, end: int):
    """Write this task's documents as one shard; a row per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, words)
        shard, out, offsets, tail = TaskContext.get().partitionId(), None, [0], np.array([end], code.dtype).tobytes()
        rows = []
        for batch in batches:
            for part in by_weight(utf8_lengths(batch.column(1)), 1 << 20):
                texts = [t or "" for t in batch.column(1)[part].to_pylist()]
                if out is None:
                    out = Attempt(folder, f"shard-{shard:07d}", ".ids")
                    out.write(MAGIC + struct.pack("<Q", code.dtype.itemsize))
                encoded = code.ids(texts)
                for ids in encoded:
                    out.write(ids + tail)
                    offsets.append(offsets[-1] + len(ids) // code.dtype.itemsize + 1)
                rows.append((batch.column(0)[part], len(texts)))
        if out is None:
            return
        table = np.array(offsets, "<u8")
        out.write(table.tobytes() + struct.pack("<QQ", len(offsets) - 1, offsets[-1]) + MAGIC)
        name, at = out.commit(), 0
        for keys, k in rows:
            start = table[at:at + k].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.full(k, shard, np.int32)), pa.array([name] * k), pa.array(np.arange(at, at + k)), pa.array(start),
                 pa.array(table[at + 1:at + k + 1].astype(np.int64) - start)], names=["doc_id", "shard", "file", "record", "start", "n"])
            at += k
    return run


def _indexed(folder: str):
    """Build and write the index file of one bucket."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bucket = table.column("bucket")[0].as_py()
        hashes = key_hashes(table.column("doc_id").combine_chunks())
        perfect = PerfectHash.build(hashes)
        slots = np.empty(len(hashes), SLOT)
        at = perfect.slots(hashes)
        slots["fingerprint"][at] = _fingerprints(hashes)
        for name in ("shard", "record", "start", "n", "copies"):
            slots[name][at] = table.column(name).to_numpy()
        packed = io.BytesIO()
        np.savez(packed, sizes=perfect.sizes, words=perfect.words, ranks=perfect.ranks, slots=slots)
        out = Attempt(folder, f"index-{bucket:07d}", ".npz")
        out.write(packed.getvalue())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "index_file": [out.commit()], "keys": pa.array([len(hashes)], pa.int64())})
    return run


def _found(folder: str):
    """Look keys up, bucket by bucket (rows are sorted by index file)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, perfect, slots = None, None, None
        for batch in batches:
            files = batch.column(1).to_pylist()
            cuts = [0, *[i for i in range(1, len(files)) if files[i] != files[i - 1]], len(files)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if files[a] != name:
                    name = files[a]
                    with opened(folder, name) as f, np.load(io.BytesIO(f.read())) as z:
                        perfect, slots = PerfectHash(z["sizes"], z["words"], z["ranks"]), z["slots"]
                keys = batch.column(0)[a:b]
                hashes = key_hashes(keys)
                at = perfect.slots(hashes)
                good = at >= 0
                good[good] = slots["fingerprint"][at[good]] == _fingerprints(hashes[good])
                hit = slots[at[good]]
                yield pa.RecordBatch.from_arrays(
                    [keys.filter(pa.array(good)), *[pa.array(hit[c].astype(np.int64)) for c in ("shard", "record", "start", "n", "copies")]],
                    names=["doc_id", "shard", "record", "start", "n", "copies"])
    return run


def _payload(folder: str, digest: bool):
    """Read ids at given places (rows are sorted by shard and place)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pydict()
            i = 0
            while i < batch.num_rows:
                name = t["file"][i]
                with opened(folder, name) as f:
                    width = struct.unpack("<Q", f.read_at(HEAD, 0)[8:])[0]
                    records, ids = struct.unpack("<QQ", f.read_at(24, f.size() - 24)[:16])
                    out: dict[str, list] = {c: [] for c in ("doc_id", "start", "n_tokens", "ids", "ids_crc32")}
                    held = 0
                    while i < batch.num_rows and t["file"][i] == name and held < 1 << 23:
                        where = HEAD + ids * width + 8 * t["record"][i]
                        lengths = np.diff(np.frombuffer(f.read_at(8 * (t["copies"][i] + 1), where), "<u8")) if t["copies"][i] > 1 else [t["n"][i]]
                        at = t["start"][i]
                        for n in map(int, lengths):
                            data = f.read_at(n * width, HEAD + at * width)
                            held += len(data)
                            out["doc_id"].append(t["doc_id"][i])
                            out["start"].append(t["base"][i] + at)
                            out["n_tokens"].append(n)
                            wide = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
                            out["ids"].append(None if digest else wide)
                            out["ids_crc32"].append(zlib.crc32(wide))
                            at += n
                        i += 1
                yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["start"], pa.int64()),
                                                  pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids"], pa.binary()),
                                                  pa.array(out["ids_crc32"], pa.int64())], names=list(out))
    return run


@dataclass
class TokenStore:
    """A written collection: its folder, shard manifest and index manifest (both tables)."""

    folder: str
    shards: DataFrame
    index: DataFrame
    buckets: int

    @classmethod
    def write(cls, docs: DataFrame, folder: str, path: str, words: str = "none", end: int = 0, bucket_keys: int = BUCKET_KEYS) -> TokenStore:
        """Encode `docs` (`doc_id`, `text`) by the tokenizers file `path` and write shards and index.

        Null text counts as empty and gives the end id alone. Rows that share an id are
        stored in the order of their texts and found together. A null id comes first.
        """
        order = F.col("doc_id").asc_nulls_first()
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        rows = rows.repartitionByRange(order).sortWithinPartitions(order, F.col("text").asc_nulls_first())
        directory = stage_arrow(rows.mapInArrow(_written(folder, path, words, end), DIRECTORY), "directory")
        sums = directory.groupBy("shard", "file").agg(F.count("*").alias("records"), F.sum("n").alias("ids"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
        shards = stage(sums.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))), "shards")
        buckets = max(1, -(-directory.count() // bucket_keys))
        keys = directory.groupBy("doc_id").agg(
            F.min(F.struct("shard", "record", "start")).alias("at"), F.sum("n").alias("n"), F.count("*").alias("copies"))
        keys = keys.select("doc_id", "at.*", "n", "copies", cls.bucket(buckets).alias("bucket"))
        index = stage(keys.groupBy("bucket").applyInArrow(_indexed(folder), "bucket int, index_file string, keys long"), "index")
        return cls(folder, shards, index, buckets)

    @staticmethod
    def bucket(buckets: int):
        return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Where the documents of `keys` (`doc_id`) lie; unknown keys give no row."""
        asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        asked = asked.withColumn("bucket", self.bucket(self.buckets)).join(self.index, "bucket")
        asked = asked.select("doc_id", "index_file").repartition("index_file").sortWithinPartitions("index_file")
        return asked.mapInArrow(_found(self.folder), "doc_id long, shard long, record long, start long, n long, copies long")

    def read(self, keys: DataFrame, digest: bool = False) -> DataFrame:
        """`doc_id`, `start` (ids before it in the collection), `n_tokens`, `ids` (little-endian 32-bit), `ids_crc32`.

        With `digest` the ids stay in the task and only their checksum is returned.
        """
        found = self.lookup(keys).join(self.shards.select("shard", "file", "base"), "shard")
        found = found.repartition("shard").sortWithinPartitions("shard", "start")
        return found.mapInArrow(_payload(self.folder, digest), "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def write_store(docs: DataFrame, path: str, words: str = "none", end: int = 0) -> TokenStore:
    from kickframe.session import scratch_path

    spark: SparkSession = docs.sparkSession
    return TokenStore.write(docs, scratch_path(spark, "tokens"), path, words, end)
