"""the formats of identifiers, learnt as masks with an alphabet for each place; identifiers.py makes values of them."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import mask_of

CLASSES = {"D": string.digits, "A": string.ascii_uppercase, "a": string.ascii_lowercase}


def learn_masks(df: DataFrame, column: str, mask: Column | None = None) -> DataFrame:
    """(mask, pos, n, chars): of every mask and place the characters that occur, over all values. mask: of a value v, by default its own."""
    v = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).withColumn("mask", mask_of(F.col("v")) if mask is None else mask)
    at = v.select("mask", F.posexplode(F.split("v", "")).alias("pos", "ch")).filter("ch <> ''")
    return at.groupBy("mask", "pos").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("ch")), "").alias("chars"))


def fixed_width(df: DataFrame) -> Column:
    """The mask of whole numbers v that are all to be as long as the longest, those below zero for themselves."""
    sign = F.when(F.col("v").startswith("-"), "-").otherwise("")
    digits = F.length("v") - F.length(sign)
    width = {r["s"]: r["w"] for r in df.groupBy(sign.alias("s")).agg(F.max(digits).alias("w")).collect()}
    return F.when(sign == "-", "-" + "D" * width.get("-", 0)).otherwise("D" * width.get("", 0))


def formats(df: DataFrame, column: str, mask: Column | None = None) -> DataFrame:
    """(mask, n, weight, alphabets) over all values of a column.

    A column of few masks is regular: there a place that never varies is kept as it is, if the mask has enough values to tell, and a
    digit that is never 0 stays so. Everything else is redrawn from its whole class; signs between are kept.
    """
    known = learn_masks(df.filter(F.col(column).cast("string") != ""), column, mask)
    masks = known.filter("pos = 0").select("mask", F.col("n").alias("rows"))
    all_of = masks.agg(F.sum("rows").alias("total"), F.count("*").alias("masks"))
    regular = F.col("masks") <= F.greatest(F.lit(8), F.floor(F.col("total") / 20))
    symbol = F.substring("mask", F.col("pos") + 1, F.lit(1))
    whole = F.lit(None).cast("string")
    for s, letters in CLASSES.items():
        whole = F.when(symbol == s, F.lit(letters)).otherwise(whole)
    constant = (F.length("chars") == 1) & (F.col("n") >= F.greatest(F.lit(20.0), 0.01 * F.col("total")))
    drawn = F.when(~regular, whole).when(constant, F.col("chars")).when((symbol == "D") & ~F.col("chars").contains("0"), F.substring(whole, 2, 9)).otherwise(whole)
    at = known.crossJoin(F.broadcast(all_of)).select("mask", "pos", "n", "total", F.when(whole.isNull(), symbol).otherwise(drawn).alias("chars"))
    got = at.groupBy("mask").agg(F.max("n").alias("n"), F.max(F.col("n") / F.col("total")).alias("weight"), F.array_sort(F.collect_list(F.struct("pos", "chars"))).alias("a"))
    return got.select("mask", "n", "weight", F.col("a.chars").alias("alphabets"))


def likeliest(df: DataFrame, column: str, most: int = 200) -> list[dict]:
    """The most frequent formats (ties: mask), to look at; decoding uses all of them."""
    return [r.asDict() for r in formats(df, column).orderBy(F.desc("n"), "mask").limit(most).collect()]
