"""Lloyd's clustering of integer vectors, sharded by dimensions.

Vectors are cut into column blocks. A task scans one block and knows only that
block's slice of the centroids; it computes exact partial distances in 64-bit
integers. Partial distances are added by vector, the least sum is its cluster.
For the update the assignments meet the slices again: the blocks are bucketed by
vector, so only the assignments (two numbers a vector) move, and a task sums the slices
of all blocks in its bucket. The driver holds the centroids, nothing that grows with
the number of vectors.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.session import scratch_path

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Columns a block. A vector sends 8 x CLUSTERS bytes per block to the sums, half of what its slice holds.
WIDTH = 32
#: Components beyond this can't be squared and summed in 64 bits.
LARGEST = 1 << 26


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """`vec_id` and `x`, the floors of the scaled components, of vectors that take part."""
    v = F.col("embedding")
    usable = (F.size(v) == dims) & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) > LARGEST))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("int"))
    return vectors.where(v.isNotNull()).where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


@dataclass
class Blocks:
    """Column blocks of all vectors in one table, bucketed by the vector's number.

    `files` reads the same rows without the buckets, in as many tasks as their size asks for.
    """

    table: str
    files: DataFrame
    borders: list[tuple[int, int]]
    spark: object

    @classmethod
    def write(cls, kept: DataFrame, dims: int, width: int) -> Blocks:
        spark = kept.sparkSession
        # As many as the sums' shuffle has partitions, so that assignments meet their slices where they are.
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        borders = [(a, min(a + width, dims)) for a in range(0, dims, width)]
        slices = F.array(*[F.struct(F.lit(i).alias("block"), F.slice("x", a + 1, b - a).alias("x")) for i, (a, b) in enumerate(borders)])
        # Ids may recur or be null, so vectors get numbers of their own; they are fixed by writing them.
        numbered = kept.withColumn("row", F.monotonically_increasing_id())
        rows = numbered.select("row", "vec_id", F.explode(slices).alias("s")).select("row", "vec_id", "s.block", "s.x")
        name = f"blocks_{uuid.uuid4().hex[:12]}"
        # By the number of the bucket: each lies in one task, whatever the number of tasks.
        path = scratch_path(spark, name)
        (rows.repartition(buckets, F.pmod(F.hash("row"), F.lit(buckets))).write.format("parquet")
         .option("path", path).partitionBy("block").bucketBy(buckets, "row").sortBy("row").saveAsTable(name))
        return cls(name, spark.read.schema(spark.table(name).schema).parquet(path), borders, spark)

    def block(self, number: int) -> DataFrame:
        return self.spark.table(self.table).where(F.col("block") == number)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _partial(centroids: np.ndarray):
    """Squared distances of a block's slices to the centroids' slices."""
    k, width = centroids.shape
    own = (centroids * centroids).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            gap = (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + own
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), *[pa.array(gap[:, j]) for j in range(k)]],
                                             names=["row", "vec_id", *[f"d{j}" for j in range(k)]])
    return run


def _sums(clusters: int, borders: list[tuple[int, int]]):
    """Component sums and sizes per cluster of the slices that a task has read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, borders[-1][1]), np.int64)
        size = np.zeros_like(total)
        for batch in batches:
            block, clustered = batch.column("block").to_numpy(), batch.column("cluster").to_numpy()
            for i in np.unique(block):
                (a, b), own = borders[i], np.flatnonzero(block == i)
                cluster = clustered[own]
                np.add.at(total[:, a:b], cluster, _matrix(batch.column("x").take(pa.array(own)), b - a))
                size[:, a:b] += np.bincount(cluster, minlength=clusters)[:, None]
        k, place = np.nonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (k.astype(np.int32), place.astype(np.int32), total[k, place], size[k, place])], names=["cluster", "place", "total", "size"])
    return run


def assign(blocks: Blocks, centroids: np.ndarray) -> DataFrame:
    """`row`, `vec_id`, `cluster`, `distance` of every vector; of equal distances the smaller number counts."""
    k = len(centroids)
    names = [f"d{j}" for j in range(k)]
    schema = "row long, vec_id long, " + ", ".join(f"{n} long" for n in names)
    # The sums are shuffled anyway, so the scans need no buckets.
    parts = [blocks.files.where(F.col("block") == i).select("row", "vec_id", "x").mapInArrow(_partial(centroids[:, a:b]), schema)
             for i, (a, b) in enumerate(blocks.borders)]
    summed = functools.reduce(DataFrame.unionAll, parts).groupBy("row").agg(F.max("vec_id").alias("vec_id"), *[F.sum(n).alias(n) for n in names])
    least = F.array_min(F.array(*[F.struct(F.col(n).alias("distance"), F.lit(j).alias("cluster")) for j, n in enumerate(names)]))
    return summed.select("row", "vec_id", least.alias("m")).select("row", "vec_id", "m.cluster", "m.distance")


def update(blocks: Blocks, assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The new centroids: the floor of the mean; an empty cluster keeps its centroid."""
    # A task per bucket takes all its blocks: the assignments are summed and sorted once.
    slices = blocks.spark.table(blocks.table).select("row", F.col("block").cast("int").alias("block"), "x")
    own = slices.hint("merge").join(assigned.select("row", "cluster"), "row").select("block", "cluster", "x")
    parts = own.mapInArrow(_sums(len(centroids), blocks.borders), "cluster int, place int, total long, size long")
    total = parts.groupBy("cluster", "place").agg(F.sum("total").alias("t"), F.sum("size").alias("n"))
    mean = F.expr("(t - pmod(t, n)) div n")  # exact, rounded down below zero as well
    moved = centroids.copy()
    for row in total.select("cluster", "place", mean.alias("mean")).collect():  # clusters x dimensions numbers
        moved[row.cluster, row.place] = row.mean
    return moved


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose seeded hash of the id is smallest; ties by content."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = kept.select(key.alias("key"), "x").orderBy("key", "x").limit(clusters).collect()
    return np.array([r.x for r in rows], np.int64)


def lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
          seed: int = SEED, width: int = WIDTH) -> DataFrame:
    """A row per vector that takes part: `vec_id`, `cluster`, `distance`, `cluster_inertia`, `inertia`, `centroid_sha256`.

    Vectors that are null, of another length, hold a null or non-finite component or one of a
    scaled size above 2^26 take no part. Repeated rows count as often as they occur; a null id
    is kept and hashed as "null". With fewer vectors than clusters there are as many clusters as
    vectors; equal vectors may leave clusters empty, whose centroids stay. An empty table gives
    no rows. Other columns are ignored.
    """
    kept = quantised(vectors, dims, scale)
    centroids = first_centroids(kept, clusters, seed)
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = Blocks.write(kept, dims, width)
    for _ in range(rounds):
        moved = update(blocks, assign(blocks, centroids), centroids)
        if (moved == centroids).all():
            break  # every further round would give the same
        centroids = moved
    out = assign(blocks, centroids)
    # As many rows as clusters.
    sums = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame([(c, s, whole, digests[c]) for c, s in sums.items()],
                                  "cluster int, a decimal(38,0), b decimal(38,0), centroid_sha256 string")
    known = known.select("cluster", F.expr("try_cast(a AS BIGINT)").alias("cluster_inertia"), F.expr("try_cast(b AS BIGINT)").alias("inertia"), "centroid_sha256")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
