"""Leaves of a forest: their densities, and an index that finds a leaf for a row without scoring every leaf."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rng import uniform
from tessera.sources.tables import settled
from tessera.types import CATEGORICAL, ColumnSpec

#: A leaf of fewer rows takes the densities of whole columns.
MIN_LEAF_ROWS = 5
#: Below this share a code counts as missing, below this deviation a column as constant.
LEAST, FLAT = 1e-12, 1e-9
#: A constant's distance within which a value is that constant; the log densities of another value, and of one outside a leaf's range.
SAME, OTHER, OUTSIDE = 1e-6, -30.0, -10.0
#: Models of more values than this are joined by shuffles instead of being sent to every executor (some 8 bytes each).
LARGEST = 20_000_000
#: What rounding could take from a bound.
SLACK = 1e-5


def densities(placed: DataFrame, columns: list[ColumnSpec], alpha: float) -> DataFrame:
    """(leaf, tree, node, n, weight, cum; each number column's mean, std, low, high, nul; each code column's (v, cum)).

    placed: (tree, node, columns), every row once for each tree, of which 0 is one. Whole columns are one more group of the same
    aggregate, over the rows of tree 0; leaves of fewer than MIN_LEAF_ROWS rows take theirs. Nulls of a code column are code -1.
    """
    num = [s.name for s in columns if s.kind != CATEGORICAL]
    cats = [s.name for s in columns if s.kind == CATEGORICAL]
    own = F.struct(F.col("tree").cast("int").alias("tree"), F.col("node").cast("double").alias("node"))
    every = F.struct(F.lit(-1).alias("tree"), F.lit(-1.0).alias("node"))
    at = F.explode(F.when(F.col("tree") == 0, F.array(own, every)).otherwise(F.array(own)))
    both = placed.select(*num, *cats, at.alias("_at")).select("_at.*", *num, *cats)
    aggs = [F.count("*").alias("n")]
    for c in num:
        x = F.col(f"`{c}`")
        aggs += [F.struct(F.avg(x).alias("mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x.isNull().cast("double")).alias("nul")).alias(c)]
    out = both.groupBy("tree", "node").agg(*aggs)
    if cats:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(f"`{c}`"), F.lit(-1.0)).alias("v")) for c in cats]))
        n = both.select("tree", "node", each.alias("x")).groupBy("tree", "node", "x.c", "x.v").agg(F.count("*").alias("k"))
        w = Window.partitionBy("tree", "node", "c")
        run = w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        smooth = F.col("k") + alpha
        shared = n.withColumn("cum", F.sum(smooth).over(run) / F.sum(smooth).over(w))
        lists = shared.groupBy("tree", "node", "c").agg(F.sort_array(F.collect_list(F.struct("v", "cum"))).alias("d"))
        out = out.join(lists.groupBy("tree", "node").pivot("c", cats).agg(F.first("d")), ["tree", "node"])
    names = [*num, *cats]
    out = settled(out, "leaf-groups")
    whole = out.filter(F.col("tree") == -1).select(*[F.col(f"`{c}`").alias(f"_all_{c}") for c in names])  # one row
    out = out.filter(F.col("tree") >= 0).join(F.broadcast(whole), F.lit(True), "left")
    few = F.col("n") < MIN_LEAF_ROWS
    out = out.select("tree", "node", "n", *[F.when(few, F.col(f"_all_{c}")).otherwise(F.col(f"`{c}`")).alias(c) for c in names])
    order = Window.orderBy("tree", "node")  # over the leaves of one model
    out = out.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return out.withColumn("cum", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("leaf", F.row_number().over(order) - 1)


def _share(d: Column, at: Column) -> Column:
    """Share of the code at a place, from 1, of (v, cum)."""
    cum = d["cum"]
    return F.try_element_at(cum, at) - F.when(at > 1, F.try_element_at(cum, F.greatest(at - 1, F.lit(1)))).otherwise(0.0)


def _likeliest(name: str) -> Column:
    """The code with the greatest share, the greater of two."""
    d = F.col(f"`{name}`")
    return F.array_max(F.transform(d, lambda e, j: F.struct(_share(d, j + 1).alias("p"), e["v"].alias("v"))))["v"]


def log_density(spec: ColumnSpec, x: Column) -> Column:
    """Log share of a code (floor LEAST), or the normal density within the leaf's range, OUTSIDE less beyond it."""
    d = F.col(f"`{spec.name}`")
    if spec.kind == CATEGORICAL:
        at = F.array_position(d["v"], F.coalesce(x, F.lit(-1.0))).cast("int")
        return F.log(F.when(at > 0, F.greatest(_share(d, at), F.lit(LEAST))).otherwise(LEAST))
    z = (x - d["mean"]) / F.greatest(d["std"], F.lit(LEAST))
    body = F.when(d["std"] > FLAT, -z * z / 2 - F.log(d["std"])).otherwise(F.when(F.abs(x - d["mean"]) <= SAME, 0.0).otherwise(OTHER))
    body = body + F.when((x < d["low"]) | (x > d["high"]), OUTSIDE).otherwise(0.0)
    return F.when(x.isNull(), F.log(F.greatest(d["nul"], F.lit(LEAST)))).otherwise(F.coalesce(body, F.lit(OTHER)) + F.log(F.greatest(1 - d["nul"], F.lit(LEAST))))


def _summary(spec: ColumnSpec) -> Column:
    """What bounds log_density over the leaves of a block."""
    d = F.col(f"`{spec.name}`")
    varies = d["std"] > FLAT
    return F.struct(
        F.max(F.log(F.greatest(d["nul"], F.lit(LEAST)))).alias("nul"),
        F.max(F.log(F.greatest(1 - d["nul"], F.lit(LEAST)))).alias("rest"),
        F.min(F.when(varies, d["mean"])).alias("first"),
        F.max(F.when(varies, d["mean"])).alias("last"),
        F.min(F.when(varies, d["std"])).alias("least"),
        F.max(F.when(varies, d["std"])).alias("most"),
        F.min(F.when(~varies, d["mean"])).alias("first_flat"),
        F.max(F.when(~varies, d["mean"])).alias("last_flat"),
        F.max(~varies).alias("flat"),
        F.min(d["low"]).alias("low"),
        F.max(d["high"]).alias("high"),
    ).alias(f"_b_{spec.name}")


def _bound(spec: ColumnSpec, x: Column) -> Column:
    """No leaf of the block has a greater log_density."""
    b = F.col(f"`_b_{spec.name}`")
    if spec.kind == CATEGORICAL:
        return F.coalesce(F.try_element_at(b, F.coalesce(x, F.lit(-1.0))), F.lit(math.log(LEAST)))
    far = F.greatest(b["first"] - x, x - b["last"], F.lit(0.0)) / b["most"]
    bell = F.when(b["most"].isNotNull(), -far * far / 2 - F.log(b["least"]))
    flat = F.when(b["flat"], F.when((x >= b["first_flat"] - SAME) & (x <= b["last_flat"] + SAME), 0.0).otherwise(OTHER))
    body = F.greatest(bell, flat) + F.when((x < b["low"]) | (x > b["high"]), OUTSIDE).otherwise(0.0)
    return F.when(x.isNull(), b["nul"]).otherwise(body + b["rest"])


class LeafIndex:
    """Draws of leaves by weight, and by weight and evidence, over a table of leaves that densities() made."""

    def __init__(self, leaves: DataFrame, columns: list[ColumnSpec]):
        self.leaves, self.columns = leaves, columns
        codes = [F.coalesce(F.size(s.name), F.lit(0)) for s in columns if s.kind == CATEGORICAL]
        self.n, listed = leaves.agg(F.count("*"), F.coalesce(F.sum(sum(codes, F.lit(0))), F.lit(0))).first()
        self.small = self.n * (6 + 5 * len(columns)) + 2 * listed <= LARGEST
        self._blocks: dict[tuple[str, ...], tuple[DataFrame, DataFrame]] = {}

    def near(self, df: DataFrame) -> DataFrame:
        """To be sent to all executors if the model's size allows it; else joins on a key shuffle."""
        return F.broadcast(df) if self.small else df

    def drawn(self, rows: DataFrame, u: str) -> DataFrame:
        """Rows with the leaf whose interval of cumulative weights holds u.

        [0, 1) is cut into as many cells as there are leaves; a leaf lies in the cells that it meets, two a leaf on average, so a row is
        held against some two leaves.
        """
        order = Window.orderBy("leaf")
        spans = self.leaves.select("leaf", F.coalesce(F.lag("cum").over(order), F.lit(0.0)).alias("_lo"), F.when(F.lead("cum").over(order).isNull(), 2.0).otherwise(F.col("cum")).alias("_hi"))
        cell = lambda x: F.least(F.floor(x * self.n), F.lit(self.n - 1)).cast("int")
        cells = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
        out = rows.withColumn("_cell", cell(F.col(u))).join(self.near(cells), "_cell")
        return out.filter((F.col(u) >= F.col("_lo")) & (F.col(u) < F.col("_hi"))).drop("_cell", "_lo", "_hi")

    def blocks(self, given: list[str]) -> tuple[DataFrame, DataFrame]:
        """(leaves with their block, their place in it and its size; blocks with what bounds their leaves): alike leaves lie together.

        About as many blocks as a block has leaves. Leaves are split by up to three of the given columns, one after another.
        """
        if tuple(given) in self._blocks:
            return self._blocks[tuple(given)]
        specs = [s for c in given for s in self.columns if s.name == c]
        by = specs[:3]
        tiles = math.ceil(math.sqrt(max(self.n, 1)) ** (1 / len(by)))
        out = self.leaves.select("leaf", "weight", *given)
        parts: list[str] = []
        for i, s in enumerate(by):
            main = _likeliest(s.name) if s.kind == CATEGORICAL else F.col(f"`{s.name}`")["mean"]
            out = out.withColumn(f"_t{i}", F.ntile(tiles).over(Window.partitionBy(*parts).orderBy(main, "leaf")))
            parts.append(f"_t{i}")
        block = Window.partitionBy("_block")
        out = out.withColumn("_block", F.dense_rank().over(Window.orderBy(*parts))).drop(*parts)
        out = settled(out.withColumns({"_place": F.row_number().over(block.orderBy("leaf")) - 1, "_size": F.count("*").over(block)}), "leaf-index")
        kept = out.groupBy("_block", "_size").agg(F.max(F.log("weight")).alias("_w"), *[_summary(s) for s in specs if s.kind != CATEGORICAL])
        for s in specs:
            if s.kind == CATEGORICAL:
                d = F.col(f"`{s.name}`")
                each = out.select("_block", F.posexplode(d["v"]).alias("j", "v"), d.alias("d")).withColumn("p", F.log(F.greatest(_share(F.col("d"), F.col("j") + 1), F.lit(LEAST))))
                top = each.groupBy("_block", "v").agg(F.max("p").alias("p")).groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("v", "p"))).alias(f"_b_{s.name}"))
                kept = kept.join(top, "_block", "left")
        self._blocks[tuple(given)] = out, settled(kept, "leaf-blocks")
        return self._blocks[tuple(given)]

    def best(self, rows: DataFrame, rid: str, given: list[str], seed: int, stream: str) -> DataFrame:
        """(rid, leaf, n_scored), a leaf drawn by weight times the density of a row's values in the given columns.

        The draw is a race: the leaf whose arrival, an exponential time over weight and density, is the first. The least time of a block's
        leaves is drawn at once with the leaf that has it; times of others are later by exponentials of their own. So a block's bound on
        weight and density and its one time bound what its leaves can reach: a row scores the block of the best bound, then only
        blocks whose bound is above what it has found. The winner is that of the race of all leaves; n_scored says
        how many were scored at last. Where evidence tells leaves apart
        that is near to the square root of their number a row; where it tells nothing, no leaf can be left out.
        """
        leaves, kept = self.blocks(given)
        specs = [s for c in given for s in self.columns if s.name == c]
        out = rows.select(rid, *[F.col(c).cast("double").alias(f"_e_{c}") for c in given])
        values = [F.first(f"_e_{c}").alias(f"_e_{c}") for c in given]
        bounded = lambda df: df.join(F.broadcast(kept), F.lit(True), "left").withColumn("_time", _time(seed, f"{stream}:block", F.col(rid), F.col("_block")) / F.col("_size"))  # noqa: E731 - a root of the leaves
        bound = F.col("_w") + sum((_bound(s, F.col(f"_e_{s.name}")) for s in specs), F.lit(SLACK)) - F.log("_time")
        first = F.floor(uniform(seed, f"{stream}:place", F.col(rid), F.col("_block")) * F.col("_size"))
        later = F.when(F.col("_place") == first, 0.0).otherwise(_time(seed, f"{stream}:race", F.col(rid), F.col("leaf")))
        score = F.log("weight") + sum((log_density(s, F.col(f"_e_{s.name}")) for s in specs), F.lit(0.0)) - F.log(F.col("_time") + later)
        won = F.max(F.struct(score.alias("score"), F.col("leaf").alias("leaf"))).alias("_won")
        inside = self.near(leaves.drop("_size"))
        # one shuffle, of a row for each row and task; what follows keeps its partitioning
        top = bounded(out).groupBy(rid).agg(*values, F.max_by(F.struct("_block", "_size", "_time"), bound).alias("_top")).select(rid, *[f"_e_{c}" for c in given], "_top.*")
        found = top.join(inside, "_block").groupBy(rid).agg(*values, won)
        left = bounded(found.withColumn("_score", F.col("_won.score")).drop("_won")).filter(bound >= F.col("_score"))
        return left.join(inside, "_block").groupBy(rid).agg(won, F.count("*").alias("n_scored")).select(rid, F.col("_won.leaf").alias("leaf"), "n_scored")


def _time(seed: int, stream: str, *ids: Column) -> Column:
    """An exponential time, never 0."""
    return F.greatest(-F.log(F.greatest(uniform(seed, stream, *ids), F.lit(1e-300))), F.lit(1e-300))
