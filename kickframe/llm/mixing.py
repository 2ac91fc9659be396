"""Mixing of sources to target weights by hierarchical budgets.

Tokens are counted per leaf of a tree domain - language - source. A token budget
flows down: siblings share their parent's budget by weight, but none gets more
than its documents yield in `epochs` passes. What a sibling can't use goes to its
siblings first, and only what a whole family can't use reaches the relatives of
its parent, since a parent's capacity is the sum of its children's. A leaf repeats
whole passes and takes of the next one the prefix that its budget pays, in an order
seeded per pass.

The order is a hash. Token sums per leaf and leading digits find where the budget
ends, and only rows with these digits are sorted, so a leaf that holds a third of
all rows is no burden.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kickframe.session import stage

#: Words between white space, the unit of budgets.
WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 4
LEAF = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Recipe:
    """`budget`: share of all tokens to take; weights are whole numbers by name, `1` for others.

    `domains` maps sources to domains, others belong to "web". A weight of 0 leaves out
    what it names. Weights of siblings may add up to 10,000.
    """

    budget: float = 1.0
    epochs: int = 1
    seed: int = 1
    domains: dict[str, str] = field(default_factory=dict)
    weights: dict[str, dict[str, int]] = field(default_factory=dict)

    def domain(self) -> Column:
        return self._choice(F.coalesce("source", F.lit("unknown")), self.domains, "web")

    def weight(self, level: str) -> Column:
        return self._choice(F.col(level), self.weights.get(level, {}), 1).cast("long")

    @staticmethod
    def _choice(column: Column, values: dict, other) -> Column:
        out = F.lit(other)
        for name, value in values.items():
            out = F.when(column == name, F.lit(value)).otherwise(out)
        return out


def share_out(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Adds `given`: the parents' `budget` shared by `weight` and capped by `cap`, exactly.

    In ascending order of capacity per weight, a child takes its capacity if its fair share of what is
    left reaches it; from the first that doesn't, all take fair shares, and odd tokens go to the first.
    """
    across = Window.partitionBy(*parent)
    line = across.orderBy(F.col("cap") / F.col("weight"), level)
    earlier, later = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = children.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
    out = out.withColumn("heavy", F.sum("weight").over(later)).withColumn("full", F.col("cap") * F.col("heavy") <= F.col("left") * F.col("weight"))
    out = out.withColumn("rest_left", F.max(F.when(~F.col("full"), F.col("left"))).over(across))
    out = out.withColumn("rest_heavy", F.max(F.when(~F.col("full"), F.col("heavy"))).over(across))
    out = out.withColumn("fair", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("rest_left * weight DIV rest_heavy")))
    odd = F.col("rest_left") - F.sum(F.when(~F.col("full"), F.col("fair"))).over(across)
    order = F.sum(F.when(F.col("full"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumn("odd", odd).withColumn("order", order)
    given = F.col("fair") + F.when(~F.col("full") & (F.col("order") <= F.col("odd")), 1).otherwise(0)
    return out.withColumn("given", given.cast("long")).drop("left", "heavy", "full", "rest_left", "rest_heavy", "fair", "odd", "order", "budget")


def named(docs: DataFrame, recipe: Recipe) -> DataFrame:
    """`doc_id`, the leaf and `n_tokens` of each row; a null language or source is "unknown"."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), recipe.domain().alias("domain"), F.coalesce("lang", F.lit("unknown")).alias("lang"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))


def leaf_budgets(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """A row per leaf: `tokens`, `given`, whole `passes` and `rest` tokens of the next pass."""
    leaves = stage(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    usable = leaves
    for level in LEAF:
        usable = usable.withColumn(f"w_{level}", recipe.weight(level)).where(F.col(f"w_{level}") > 0)
    usable = usable.withColumn("cap", F.col("tokens") * recipe.epochs)
    total = F.floor(F.sum("tokens").over(Window.partitionBy()) * F.lit(recipe.budget)).cast("long")  # a row per domain
    tokens = leaves.groupBy("domain").agg(F.sum("tokens").alias("tokens"))
    tokens = tokens.select("domain", total.alias("budget"))
    domains = usable.groupBy("domain", F.col("w_domain").alias("weight")).agg(F.sum("cap").alias("cap")).join(tokens, "domain")
    domains = share_out(domains.withColumn("all", F.lit(0)), ["all"], "domain").select("domain", F.col("given").alias("budget"))
    langs = usable.groupBy("domain", "lang", F.col("w_lang").alias("weight")).agg(F.sum("cap").alias("cap")).join(domains, "domain")
    langs = share_out(langs, ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    sources = usable.withColumn("weight", F.col("w_source")).select(*LEAF, "tokens", "weight", "cap").join(langs, ["domain", "lang"])
    given = share_out(sources, ["domain", "lang"], "source")
    passes = F.when(F.col("tokens") > 0, F.expr("given DIV tokens")).otherwise(F.lit(0)).cast("long")
    given = given.withColumn("passes", passes).withColumn("rest", F.col("given") - F.col("passes") * F.col("tokens"))
    return stage(given.select(*LEAF, "tokens", "given", "passes", "rest"), "budgets")


def order_key(recipe: Recipe, prefix: str = "") -> Column:
    """Place of a document in the pass after the whole ones."""
    ident = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", F.lit(str(recipe.seed)), F.col(f"{prefix}passes").cast("string"), ident).cast("binary"))


def cuts(rows: DataFrame, budgets: DataFrame, recipe: Recipe) -> DataFrame:
    """A row per leaf: `passes`, and the `digits` and `last` key where its prefix ends."""
    keyed = rows.join(budgets, LEAF).where("tokens > 0").withColumn("key", order_key(recipe))
    digits = F.substring("key", 1, DIGITS)
    sums = keyed.groupBy(*LEAF, "rest", digits.alias("digits")).agg(F.sum("n_tokens").alias("n"))
    line = Window.partitionBy(*LEAF).orderBy("digits")
    run = sums.withColumn("upto", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = stage(run.where("upto > rest").groupBy(*LEAF).agg(F.min(F.struct("digits", (F.col("upto") - F.col("n")).alias("base"))).alias("edge"))
                 .select(*LEAF, "edge.*"), "edges")
    near = keyed.join(edge, LEAF).where(digits == F.col("digits"))
    # Equal keys stand or fall together.
    near = near.withColumn("upto", F.sum("n_tokens").over(
        Window.partitionBy(*LEAF).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("base"))
    last = near.where("upto <= rest").groupBy(*LEAF).agg(F.max("key").alias("last"))
    out = budgets.join(edge.select(*LEAF, "digits"), LEAF, "left").join(last, LEAF, "left")
    return stage(out.select(*LEAF, "passes", "digits", "last"), "cuts")


def copies(recipe: Recipe, prefix: str = "") -> Column:
    """How often a document is taken, next to its leaf's cut."""
    key = order_key(recipe, prefix)
    taken = (F.substring(key, 1, DIGITS) < F.col(f"{prefix}digits")) | (key <= F.coalesce(f"{prefix}last", F.lit("")))
    return F.col(f"{prefix}passes") + F.coalesce(taken, F.lit(False)).cast("long")


def select(docs: DataFrame, recipe: Recipe) -> DataFrame:
    """`doc_id`, `domain`, `lang`, `source`, `n_tokens` and `copies` (0: not taken) of each row.

    Null text counts as empty and costs nothing. A leaf without tokens, or of weight 0, takes
    nothing. Rows that share an id stand or fall together. An empty table gives no rows.
    """
    rows = stage(named(docs, recipe), "named")
    ends = cuts(rows, leaf_budgets(rows, recipe), recipe)
    out = rows.join(ends, LEAF, "left")
    return out.select("doc_id", *LEAF, "n_tokens", F.coalesce(copies(recipe), F.lit(0).cast("long")).alias("copies"))


def mix(docs: DataFrame, recipe: Recipe) -> DataFrame:
    """The rows of `docs` that the recipe takes, each as often as it says; all columns kept."""
    rows = stage(named(docs, recipe), "named")
    ends = cuts(rows, leaf_budgets(rows, recipe), recipe)
    names = {c: f"__{c}" for c in (*LEAF, "passes", "digits", "last")}
    ends = ends.select(*[F.col(c).alias(n) for c, n in names.items()])
    same = ((recipe.domain() == F.col("__domain")) & (F.coalesce(docs["lang"], F.lit("unknown")) == F.col("__lang"))
            & (F.coalesce(docs["source"], F.lit("unknown")) == F.col("__source")))
    out = docs.join(ends, same).withColumn("__times", copies(recipe, "__")).where("__times > 0")
    if recipe.epochs > 1:
        out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return out.select([F.col(f"`{c}`") for c in docs.columns])
