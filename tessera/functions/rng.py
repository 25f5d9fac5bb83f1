"""Counter-based randomness: every draw is a function of (seed, stream, row id), so results hold for any partitioning and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 4503599627370496.0  # 2 ** 52


def uniform(seed: int | str, stream: str, *ids: Column) -> Column:
    """A uniform double in [0, 1) for each row id. Bind it to a column of its own before using it in several branches."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(SCALE)


def order_key(seed: int | str, stream: str, *ids: Column) -> Column:
    """A text that orders rows at random but alike every time."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[i.cast("string") for i in ids]))


def pick(u: Column, cumulative: Column) -> Column:
    """Index (from 0) of the outcome that u falls on, by an array of cumulative probabilities."""
    return F.least(F.size(F.filter(cumulative, lambda c: c <= u)), F.size(cumulative) - 1)


def laplace(u: Column, scale: float) -> Column:
    """Laplace noise from a uniform, by the inverse distribution."""
    x = u - 0.5
    return -F.lit(scale) * F.signum(x) * F.log(F.greatest(1 - 2 * F.abs(x), F.lit(1e-300)))


def uniform_sql(seed: int | str, stream: str, *ids: str) -> str:
    """The same uniform in DuckDB's SQL."""
    parts = ", ".join([f"'{seed}'", f"'{stream}'", *[f"CAST({i} AS VARCHAR)" for i in ids]])
    return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 13) AS BIGINT) AS DOUBLE) / {SCALE:.1f})"
