"""Near-duplicate vectors: subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance 2 - 2t. After a rotation
the distance is the sum over low-dimensional blocks, so in at least one block it
is within that block's share of the budget. Each block is a range join: vectors
are laid in slabs along its first coordinate, at least as wide as the block's
radius, and wider where a label has few vectors. They meet those of their own
slab and, when within the radius of its border, those of the next one. Within a
comparison both sides are put in k-d order over all coordinates of the block;
only vectors within the radius of a leaf's bounding box meet the leaf. What
passes a block is verified in double precision on the whole vectors at once, and
counted by the first block that it passes, so nothing is counted twice and no
list of pairs leaves a task.

Equal vectors of a label are one class from the start. Slabs are cut into chunks
of bounded size and compared chunk by chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm.components import components
from kickframe.session import stage

BLOCKS, CHUNK, SEED = 8, 8000, 20240607
#: Vectors in a leaf of the k-d order, and bytes of vectors that are verified at once.
LEAF, VERIFIED = 6, 32 << 20
#: Slack of the block test, which runs in single precision.
EPSILON = 1e-5
PARTS = "label long, k1 long, k2 long, rep long, low long, near long"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """An orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def shares(dim: int, blocks: int) -> list[tuple[int, int]]:
    """Borders of the blocks; a block's share of the budget is its share of the dimensions."""
    cuts = [round(i * dim / blocks) for i in range(blocks + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _rotated(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and their rotated form, added up in one order so that every task gets the same bits."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    turned = np.zeros_like(unit)
    for part, row in zip(unit.T, rotation(unit.shape[1]), strict=True):
        turned += part[:, None] * row
    return unit, turned.astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _firsts(blocks: int):
    """Each vector with the first coordinate of every block."""
    def run(batches):
        for batch in batches:
            sizes = np.array(batch.column("embedding").value_lengths())
            for dim in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == dim))
                _, turned = _rotated(_matrix(own.column("embedding")))
                firsts = turned[:, [a for a, _ in shares(dim, blocks)]]
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(np.full(own.num_rows, dim, np.int32)), pa.array(list(firsts), pa.list_(pa.float32()))],
                    names=[*own.schema.names, "dim", "firsts"])
    return run


def _leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Rows in k-d order: halved along the widest coordinate until a part has at most `leaf` rows."""
    out, todo = [], [np.arange(len(points))] if len(points) else []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        own = points[rows]
        cut = len(rows) // 2
        order = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], cut)
        todo += [rows[order[:cut]], rows[order[cut:]]]
    return out


def meetings(x: np.ndarray, y: np.ndarray | None, reach: float):
    """Rows of `x` and rows of `y` that have to be compared: each pair within squared distance `reach` is in one meeting.

    Without `y`, `x` meets itself; a pair of a leaf with itself then comes in both orders.
    """
    mine = _leaves(x)
    others, z = (mine, x) if y is None else (_leaves(y), y)
    if not mine or not others:
        return
    starts = np.concatenate(([0], np.cumsum([len(r) for r in others])))
    rows = np.concatenate(others)
    z = z[rows]
    low, high = np.minimum.reduceat(z, starts[:-1]), np.maximum.reduceat(z, starts[:-1])
    of = np.repeat(np.arange(len(others)), np.diff(starts))
    for number, leaf in enumerate(mine):
        points = x[leaf]
        bottom, top = points.min(0), points.max(0)
        apart = np.maximum(np.maximum(bottom - high, low - top), 0)
        close = np.einsum("ij,ij->i", apart, apart) <= reach
        if y is None:
            close[:number] = False
        at = np.flatnonzero(close[of])
        apart = np.maximum(np.maximum(bottom - z[at], z[at] - top), 0)
        at = at[np.einsum("ij,ij->i", apart, apart) <= reach]
        if len(at):
            yield leaf, rows[at]


def _merge(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Components after linking p with q; every entry of `root` names the lowest of its component."""
    while True:
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return root
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _compare(threshold: float, blocks: int):
    """Links between two chunks: per class how many vectors it meets, and its local component."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        number = table.column("block")[0].as_py()
        left_side = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        group, k1, k2, rep, mult = (table.column(c).to_numpy() for c in ("label", "k1", "k2", "rep", "mult"))
        vectors = table.column("embedding")
        unit, turned = _rotated(_matrix(vectors.chunk(0) if vectors.num_chunks == 1 else vectors.combine_chunks()))
        dim = unit.shape[1]
        cuts = shares(dim, blocks)
        budget = [(2 - 2 * threshold) * (b - a) / dim + EPSILON for a, b in cuts]
        following, first, second = (table.column(c)[0].as_py() for c in ("next", "i", "j"))
        same = not following and first == second
        left = np.flatnonzero(left_side)
        right = left if same else np.flatnonzero(~left_side)
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), np.int64)
        rank[order] = np.arange(len(rep))  # so that the lowest of a component is its smallest id
        near, state = np.zeros(len(rep), np.int64), {"root": np.arange(len(rep))}
        step = max(1, VERIFIED // (8 * dim))

        def verify(p: np.ndarray, q: np.ndarray) -> None:
            ok = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
            p, q = p[ok], q[ok]
            # Unlike products, differences round alike in every task.
            gaps = [((turned[p, c:d] - turned[q, c:d]) ** 2).sum(1) for c, d in cuts[:number + 1]]
            passed = gaps[number] <= budget[number]
            for one, most in zip(gaps[:number], budget[:number], strict=True):
                passed &= one > most
            p, q = p[passed], q[passed]
            np.add.at(near, p, mult[q])
            np.add.at(near, q, mult[p])
            state["root"] = _merge(state["root"], rank[p], rank[q])

        a, b = cuts[number]
        x, y = turned[left, a:b], turned[right, a:b]
        waiting, held = [], 0
        for rows, columns in meetings(x, None if same else y, budget[number] + EPSILON):
            u, v = x[rows], y[columns]
            gap = (u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (u @ v.T)
            p, q = np.nonzero(gap <= budget[number] + EPSILON)
            p, q = rows[p], columns[q]
            if same:
                # Within a leaf each pair once; the rows of other leaves come after this leaf only.
                own = np.isin(q, rows)
                keep = ~own | (p < q)
                p, q = p[keep], q[keep]
            waiting.append((left[p], right[q]))
            held += len(p)
            if held >= step:
                p, q = (np.concatenate(side) for side in zip(*waiting, strict=True))
                for part in range(0, len(p), step):
                    verify(p[part:part + step], q[part:part + step])
                waiting, held = [], 0
        if held:
            verify(*(np.concatenate(side) for side in zip(*waiting, strict=True)))
        out = np.flatnonzero(near)
        names = rep[order][state["root"][rank[out]]]
        return pa.table({"label": group[out], "k1": k1[out], "k2": k2[out], "rep": rep[out], "low": names, "near": near[out]})
    return run


def _prepared(vectors: DataFrame) -> DataFrame:
    """All rows; those that can have links carry the 128-bit key (`k1`, `k2`) of their vector."""
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    v = F.transform("embedding", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))  # -0.0 is 0.0
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("embedding"))
    fit = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
           & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
    return rows.withColumn("k1", F.when(fit, F.xxhash64("embedding"))).withColumn("k2", F.when(fit, F.xxhash64(F.lit(7), "embedding")))


def _laid(rows: DataFrame, threshold: float, blocks: int, chunk: int) -> DataFrame:
    """A row per vector and block: its `slab`, and whether it lies within the radius of the next (`up`) and the last one (`down`).

    Coordinates of unit vectors lie between -1 and 1. The fewer vectors a label has, the wider are
    its slabs: up to `chunk` vectors are one slab, and many times more have slabs as wide as the radius.
    """
    counts = stage(rows.groupBy("label", "dim").agg(F.count("*").alias("many")), "counts")
    spots = rows.join(counts, ["label", "dim"]).select("*", F.posexplode("firsts").alias("block", "first")).drop("firsts")
    number = F.least(F.lit(blocks), F.col("dim"))
    share = F.round((F.col("block") + 1) * F.col("dim") / number) - F.round(F.col("block") * F.col("dim") / number)
    # One dimension more than the rounded share, so that a tie in rounding can't make a slab too narrow.
    spots = spots.withColumn("reach", F.sqrt(F.lit(2 - 2 * threshold) * (share + 1) / F.col("dim") + 2 * EPSILON) + EPSILON)
    spots = spots.withColumn("wide", F.col("reach") * F.ceil(F.lit(2.01) / F.col("reach") * chunk / F.col("many")))
    spots = spots.withColumn("place", (F.col("first").cast("double") + 1.001) / F.col("wide"))
    spots = spots.withColumn("slab", F.floor("place").cast("int"))
    inside, margin = F.col("place") - F.col("slab"), F.col("reach") / F.col("wide")
    return spots.select("label", "dim", "block", "slab", (inside + margin >= 1).alias("up"), (inside <= margin).alias("down"),
                        "k1", "k2", "rep", "mult", "embedding")


def _work(laid: DataFrame, chunk: int) -> DataFrame:
    """A row per vector and comparison that it takes part in.

    Item (`at`, `i`, `j`) compares chunk i of slab `at` with chunk j of the same slab, or of the next one when `next`.
    """
    where = ["label", "dim", "block", "slab"]
    chunks = stage(laid.groupBy(*where).agg(F.ceil(F.count("*") / chunk).cast("int").alias("n")), "chunks")
    above = chunks.withColumn("slab", F.col("slab") - 1).withColumnRenamed("n", "above")
    below = chunks.withColumn("slab", F.col("slab") + 1).withColumnRenamed("n", "below")
    sizes = chunks.join(above, where, "left").join(below, where, "left").na.fill(0, ["above", "below"])
    rows = laid.join(sizes, where).withColumn("own", F.pmod(F.xxhash64("k1", "k2"), F.col("n")).cast("int"))
    own, slab = F.col("own"), F.col("slab").cast("int")

    def items(count: str, meets, at, following: bool, i, j, left):
        numbers = F.when((F.col(count) > 0) & meets, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda k: F.struct(
            at.alias("at"), F.lit(following).alias("next"), i(k).alias("i"), j(k).alias("j"), left(k).alias("left")))

    within = items("n", F.lit(True), slab, False, lambda k: F.least(own, k), lambda k: F.greatest(own, k), lambda k: own <= k)
    upward = items("above", F.col("up"), slab, True, lambda k: own, lambda k: k, lambda k: F.lit(True))
    downward = items("below", F.col("down"), slab - 1, True, lambda k: k, lambda k: own, lambda k: F.lit(False))
    return rows.withColumn("item", F.explode(F.concat(within, upward, downward))).select(
        "label", "dim", "block", "item.*", "k1", "k2", "rep", "mult", "embedding")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Per row of `vectors` (`vec_id`, `embedding`, `label`): `vec_id`, `n_links`, `component_id`, `kept`.

    Vectors are linked when their labels are equal, their lengths are and their cosine in
    double precision is at least `threshold`. Null, empty and zero vectors, those with null or
    non-finite components, and rows with a null label or id have no links. A row that repeats
    another's id and vector counts as one more vector. An empty table gives no rows.
    """
    rows = stage(_prepared(vectors), "vectors")
    classes = stage(rows.where("k1 IS NOT NULL").groupBy("label", "k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("embedding").alias("embedding")), "classes")
    kind = classes.schema["embedding"].dataType.simpleString()
    turned = stage(classes.mapInArrow(
        _firsts(blocks), f"label long, k1 long, k2 long, rep long, mult long, embedding {kind}, dim int, firsts array<float>"), "turned")
    work = _work(_laid(turned, threshold, blocks, chunk), chunk)
    parts = stage(work.groupBy("label", "dim", "block", "next", "at", "i", "j").applyInArrow(_compare(threshold, blocks), PARTS), "parts")
    found = components(parts.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct())
    near = parts.groupBy("label", "k1", "k2").agg(F.sum("near").alias("near"))
    known = classes.select("label", "k1", "k2", "rep", "mult").join(near, ["label", "k1", "k2"], "left")
    known = known.join(found.withColumnRenamed("node", "rep"), "rep", "left").where("mult > 1 OR near IS NOT NULL")
    known = stage(known.select("label", "k1", "k2", (F.col("mult") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"),
                               F.coalesce("component", "rep").alias("component_id")), "verdicts")
    out = rows.select("vec_id", "label", "k1", "k2").join(known, ["label", "k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
