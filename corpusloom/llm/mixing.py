"""Mixing sources to target weights through a domain-language-source tree.

Weights go down the tree: a child's share of its parent's budget is its weight among its siblings.
A child's capacity is what its leaves hold over the allowed epochs. Budgets are filled like water:
a child short of its share is filled up and the rest goes to its siblings by weight, so only what
a whole family cannot take reaches its ancestors' siblings. A leaf then takes whole seeded epochs
and the prefix of one more, in the order of a hash of (seed, epoch, doc_id), up to its budget.

Leaf sums are pre-aggregated; the tree is one row for each leaf. A leaf's prefix is found without
sorting the leaf: hashes are dealt to ``CELLS`` cells, sums by cell tell which are in, which are
out, and the one cell that the budget cuts; that cell is dealt to ``CELLS`` cells again, and only
documents of the one that is cut (one in ``CELLS ** 2`` of a leaf) are ordered.

Defined cases: null domain, language or source is a branch named ''; a null text has no tokens
and is taken in every whole epoch and never in a prefix; rows repeating a doc_id are taken each, ties
of a prefix going by text; a weight of zero gives a branch nothing until its siblings are full; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, materialize, table

CELLS = 4096
LEVELS = ("domain", "language", "leaf")
#: Target weights of the registered query: shares of the domains; languages and sources go by power.
TARGETS = (("domain", "domain0", 0.4), ("domain", "domain1", 0.3), ("domain", "domain2", 0.2), ("domain", "domain3", 0.1))


@dataclass(frozen=True)
class Mix:
    """Targets: tokens wanted as a multiple of the tokens there are; the weight of a branch is
    (tokens it holds) ** power unless ``weights`` names it by level; epochs bound repetition."""

    tokens: float = 1.0
    power: float = 0.9
    epochs: int = 2
    seed: int = 17
    weights: tuple[tuple[str, str, float], ...] = ()


def domain_of(source: Column) -> Column:
    """A domain for sources that name none: one of four, by checksum."""
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce(source.cast("string"), F.lit("")).cast("binary")) % 4).cast("string"))


def tokens_of(text: Column) -> Column:
    """Words of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{WHITE[1:-1]}]+")).cast("long")


def _fill(rows: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Deal each parent's budget to its rows by ``weight``, none above its ``capacity``. Rows by
    capacity / weight: those up to the level at which the rest has its full share are filled."""
    rows = rows.withColumn("_r", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    w = Window.partitionBy(*parent).orderBy("_r", "name").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    before = rows.withColumn("_c", F.coalesce(F.sum("capacity").over(w), F.lit(0.0))).withColumn("_w", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(w), F.lit(0.0)))
    level = F.greatest(F.col(budget) - F.col("_c"), F.lit(0.0)) / F.col("_w")
    # The level at which the first row that is not full stands is that of all after it.
    before = before.withColumn("_full", F.when(F.col("_r") == float("inf"), F.lit(False)).otherwise(F.col("_r") <= level)).withColumn("_level", level)
    first = F.min(F.when(~F.col("_full") & (F.col("weight") > 0), F.struct("_r", "name", "_level"))).over(whole)
    dealt = before.withColumn("_l", first["_level"])
    given = F.when(F.col("_full"), F.col("capacity")).when(F.col("weight") > 0, F.least(F.col("capacity"), F.col("weight") * F.col("_l")))
    # Rows without weight take what is left, in order.
    given = F.coalesce(given, F.greatest(F.lit(0.0), F.least(F.col("capacity"), F.col(budget) - F.col("_c"))))
    return dealt.withColumn(out, given).drop("_r", "_c", "_w", "_full", "_level", "_l")


def _weight(level: str, name: Column, tokens: Column, mix: Mix) -> Column:
    out = F.pow(tokens.cast("double"), F.lit(mix.power))
    for at, which, value in mix.weights:
        if at == level:
            out = F.when(name == which, F.lit(float(value))).otherwise(out)
    return out


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: (domain, language, leaf, tokens). Adds the budget of each leaf, in whole tokens."""
    leaves = leaves.withColumn("capacity", F.col("tokens").cast("double") * mix.epochs)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    at, keys = None, []
    for k, level in enumerate(LEVELS):
        nodes = leaves.groupBy(*keys, level).agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"))
        nodes = nodes.join(at, keys) if keys else nodes.withColumn("budget0", F.lit(float(total * mix.tokens)))
        nodes = nodes.withColumn("name", F.col(level)).withColumn("weight", _weight(level, F.col(level), F.col("tokens"), mix))
        parent = keys or [F.lit(0)]
        at = _fill(nodes, parent, f"budget{k}", f"budget{k + 1}").select(*keys, level, f"budget{k + 1}")
        keys = [*keys, level]
    # Rounded before it is cut, so that a share that is whole in exact arithmetic stays so.
    return leaves.join(at.select(*keys, F.floor(F.round(F.col(f"budget{len(LEVELS)}"), 3)).alias("budget")), keys).select(*keys, "tokens", "budget")


def _cut(dealt: DataFrame, cell: str) -> DataFrame:
    """(levels, cut_<cell>, before): of each leaf the cell in which ``start`` and the tokens summed in
    the order of cells pass ``rest``, and the sum before it; leaves that never pass are absent."""
    sums = dealt.groupBy(*LEVELS, cell).agg(F.sum("tokens").alias("held"), F.first("rest").alias("rest"), F.first("start").alias("start"))
    before = F.col("start") + F.coalesce(F.sum("held").over(Window.partitionBy(*LEVELS).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sums.withColumn("before", before).where("before + held > rest").groupBy(*LEVELS).agg(F.min(F.struct(cell, "before")).alias("cut"))
    return materialize(first.select(*LEVELS, F.col(f"cut.{cell}").alias(f"cut_{cell}"), F.col("cut.before").alias("before")), f"cut-{cell}s")


def select(docs: DataFrame, mix: Mix = Mix(), domain: Column | None = None, language: str = "lang", source: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs that is taken: row (its columns), domain, language, leaf,
    tokens, epochs (whole ones), extra (1 if also in the last, partial one) and copies."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        name(domain if domain is not None else domain_of(F.col(source))).alias("domain"),
        name(F.col(language)).alias("language"),
        name(F.col(source)).alias("leaf"),
        tokens_of(F.col(text)).alias("tokens"),
        F.xxhash64(F.col(id_col)).alias("h"),
        F.xxhash64(F.col(text)).alias("tie"),
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = materialize(budgets(materialize(leaves, "leaves"), mix), "leaf-budgets")
    plan = plan.select(*LEVELS, F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(mix.epochs))).otherwise(F.lit(mix.epochs)).cast("int").alias("epochs"), "budget", F.col("tokens").alias("held"))
    plan = plan.withColumn("rest", F.when(F.col("epochs") >= mix.epochs, F.lit(0)).otherwise(F.col("budget") - F.col("epochs") * F.col("held")).cast("long")).drop("budget", "held")
    small = plan.count() <= 100_000
    plan = F.broadcast(plan) if small else plan
    # The order of the partial epoch: its number is part of the hash.
    bits = CELLS.bit_length() - 1
    dealt = rows.join(plan, list(LEVELS)).withColumn("h", F.xxhash64(F.lit(mix.seed), F.col("epochs"), F.col("h")))
    dealt = dealt.withColumn("cell", F.shiftrightunsigned("h", 64 - bits).cast("int")).withColumn("sub", (F.shiftrightunsigned("h", 64 - 2 * bits) % CELLS).cast("int"))
    cut = _cut(dealt.where("rest > 0").withColumn("start", F.lit(0).cast("long")), "cell")
    cut = F.broadcast(cut) if small else cut
    within = dealt.where("rest > 0").join(cut.withColumnRenamed("before", "start"), list(LEVELS)).where("cell = cut_cell")
    cut = cut.drop("before").join(_cut(within, "sub"), list(LEVELS))
    cut = F.broadcast(cut) if small else cut
    dealt = dealt.join(cut, list(LEVELS), "left")
    inside = (F.col("rest") > 0) & (F.col("cut_cell").isNull() | (F.col("cell") < F.col("cut_cell")) | ((F.col("cell") == F.col("cut_cell")) & (F.col("sub") < F.col("cut_sub")))) & (F.col("tokens") > 0)
    at_cut = (F.col("rest") > 0) & (F.col("cell") == F.col("cut_cell")) & (F.col("sub") == F.col("cut_sub")) & (F.col("tokens") > 0)
    shown = ["row", *LEVELS, "tokens", "epochs"]
    plain = dealt.where(~F.coalesce(at_cut, F.lit(False))).select(*shown, F.coalesce(inside, F.lit(False)).cast("int").alias("extra"))
    run = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("h", "tie").rowsBetween(Window.unboundedPreceding, 0))
    edge = dealt.where(at_cut).withColumn("run", run).select(*shown, (F.col("before") + F.col("run") <= F.col("rest")).cast("int").alias("extra"))
    return plain.unionByName(edge).withColumn("copies", F.col("epochs") + F.col("extra")).where("copies > 0")


def mixed(docs: DataFrame, mix: Mix = Mix(), **names) -> DataFrame:
    """The rows of docs, each as often as it was taken."""
    taken = select(docs, mix, **names)
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("_")).select("row.*")


def op5_hierarchical_mix(spark, sf_dir: str) -> DataFrame:
    taken = select(table(spark, sf_dir, "documents"), Mix(weights=TARGETS))
    return taken.select(F.col("row.doc_id").alias("doc_id"), *LEVELS, "tokens", "epochs", "extra", "copies")
