"""Mixing sources to target weights.

A token budget runs down a tree of domains, languages and sources. Children of a node share its budget
by weight; what a child cannot supply goes to its siblings by weight, and only what no sibling can take
leaves the node, because a node's own capacity is the sum of its leaves'. Each leaf then supplies a
prefix of its endless stream of epochs, each a seeded shuffle of all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import running_before
from sentrylake.session import staged


def _weight(path: Column, parts: dict[str, float], default: float) -> Column:
    if not parts:
        return F.lit(float(default))
    table = F.create_map(*[F.lit(x) for name, w in sorted(parts.items()) for x in (name, float(w))])
    return F.coalesce(table[path], F.lit(float(default)))


def _pour(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Water filling of `budget` (a column of the parent, on every child) into `capacity` by `weight`:
    with children sorted by capacity over weight, the level is the largest of what is left over the
    weight that is left; a child gets its weight times the level, or its capacity if that is less."""
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    nodes = nodes.withColumn("_level", left / share)
    return nodes.withColumn("budget", F.least("capacity", F.col("weight") * F.max("_level").over(whole))).drop("_level")


def quotas(leaves: DataFrame, levels: list[str], parts: dict[str, float], budget: Column, default: float, max_epochs: int) -> DataFrame:
    """levels, available, quota (whole tokens) of every leaf. leaves: levels and available."""
    weights = [_weight(F.concat_ws("/", *levels[: i + 1]), parts, default) for i in range(len(levels))]
    alive = leaves.withColumn("capacity", F.col("available").cast("double") * max_epochs)
    for i, w in enumerate(weights):
        alive = alive.withColumn(f"_w{i}", w).where(F.col(f"_w{i}") > 0)
    total = leaves.agg(budget.cast("double").alias("budget"))
    parents = total
    for i, name in enumerate(levels):
        nodes = alive.groupBy(*levels[: i + 1]).agg(F.sum("capacity").alias("capacity"), F.first(f"_w{i}").alias("weight"))
        nodes = nodes.join(parents, levels[:i]) if i else nodes.join(parents)  # the root is a single row
        parents = _pour(nodes, levels[:i], name).select(*levels[: i + 1], "budget")
    return leaves.join(parents, levels).select(*levels, "available", F.floor("budget").cast("bigint").alias("quota"))


def mix(df: DataFrame, id_col: str, tokens: Column, levels: dict[str, Column], parts: dict[str, float], share: float,
        max_epochs: int = 4, default: float = 1.0, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """The selected rows: id, the levels, epoch, start (tokens of the leaf's stream before the row),
    tokens and take_tokens (fewer than tokens only for a leaf's last row), then the columns of carry.

    parts maps 'domain', 'domain/language' or 'domain/language/source' to a weight; what is not named
    weighs `default`, and a weight of 0 takes nothing from there. The budget is `share` of all tokens.
    A leaf gives at most max_epochs epochs. If the whole tree can't supply the budget, all of it is
    taken and the total is short.

    A null level is the empty name, a null token count is 0. A row without tokens is selected if it
    stands before the end of its leaf's prefix. Null ids shuffle as the empty text. Repeated rows are
    rows of their own. An empty table gives an empty table. Other columns may have any name.

    The leaf table holds a row per (domain, language, source). A leaf with a third of all rows is cut
    by the shuffle hash into 4,096 slices, and slices past the quota are dropped before any sort."""
    names = list(levels)
    rows = staged(df.select(F.col(id_col).alias("_id"), *carry, *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()],
                            F.coalesce(tokens.cast("bigint"), F.lit(0)).alias("tokens")))
    leaves = staged(rows.groupBy(*names).agg(F.sum("tokens").alias("available")))
    wanted = quotas(leaves, names, parts, F.sum("available") * F.lit(float(share)), default, max_epochs).where("quota > 0")
    wanted = wanted.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil((F.col("quota") - 1) / F.col("available")).cast("int"))))
    wanted = wanted.where(F.col("epoch") * F.col("available") < F.col("quota")).withColumn("_left", F.col("quota") - F.col("epoch") * F.col("available"))
    copies = rows.join(wanted, names).withColumn("_hex", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    placed = running_before(copies, [*names, "epoch"], "_hex", ["tokens", *carry], "tokens", "_at").where("_at < _left")
    return placed.select(F.col("_id").alias(id_col), *names, "epoch", (F.col("_at") + F.col("epoch") * F.col("available")).alias("start"), "tokens",
                         F.least(F.col("tokens"), F.col("_left") - F.col("_at")).alias("take_tokens"), *carry)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")
