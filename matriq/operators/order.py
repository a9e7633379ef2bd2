"""Places of rows in a total order, without one task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matriq.lineage import cut

#: Ranges that a column of numbers is cut into before its rows are numbered.
PARTS = 64
#: Ranges that each group of `running` is cut into.
RANGES = 32
#: Groups whose cuts, RANGES numbers each, are broadcast; more are joined by a shuffle.
MAX_GROUPS = 20_000


def positions(df: DataFrame, ord_col: str, tie: str, by: Sequence[str] = (), name: str = "_k") -> DataFrame:
    """df with the place, from 0, of each row by (ord_col, tie), within each `by`.

    The column's quantiles, as literals of the plan, cut it into ranges; rows are numbered in their range, and
    the counts of the ranges before, PARTS rows a group, are added. Other columns without `by` are sorted by Spark's ranges.
    """
    numeric = dict(df.dtypes)[ord_col] in ("double", "float", "int", "bigint", "smallint", "tinyint")
    if not numeric and not by:
        return _sorted_positions(df, ord_col, tie, name)
    cuts = sorted(set(df.stat.approxQuantile(ord_col, [i / PARTS for i in range(1, PARTS)], 0.005))) if numeric else []
    part = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: F.col(ord_col) > c)) if cuts else F.lit(0)
    p = df.withColumn("_p", part)
    before = p.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    before = before.withColumn("_b", F.sum("_c").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_c")).drop("_c")
    k = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(ord_col, tie)) - 1
    out = p.withColumn("_r", k).join(F.broadcast(before) if not by else before, [*by, "_p"])
    return out.withColumn(name, F.col("_r") + F.col("_b")).drop("_p", "_r", "_b")


def _sorted_positions(df: DataFrame, ord_col: str, tie: str, name: str) -> DataFrame:
    """positions() by a sort of all rows: numbered in their part, written once, plus the counts of the parts before."""
    rows = df.orderBy(ord_col, tie).withColumn("_p", F.spark_partition_id()).withColumn("_r", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return numbered(cut(rows), ["_p"], "_r", name)


def numbered(rows: DataFrame, part: Sequence[str], ord_col: str, name: str) -> DataFrame:
    """rows with their number, from 0, over parts in order, within which ord_col has no gaps; one row a part is sorted in one task."""
    before = rows.groupBy(*part).agg(F.count("*").alias("_c"), F.min(ord_col).alias("_m"))
    before = before.withColumn("_b", F.sum("_c").over(Window.orderBy(*part)) - F.col("_c") - F.col("_m")).drop("_c", "_m")
    return rows.join(F.broadcast(before), [*part]).withColumn(name, F.col(ord_col) + F.col("_b")).drop(*part, ord_col, "_b")


def running(df: DataFrame, value: str, amount: str, by: Sequence[str], name: str, descending: bool = False, least: bool = False, total: str | None = None) -> DataFrame:
    """df with `name`: the sum (least: the minimum) of `amount` over a group's rows up to each row, in order of `value`.

    Among equal values larger amounts come first. A group of any size is cut by its own quantiles into RANGES ranges; windows
    run within a range, and what the ranges before it come to is added. Approximate quantiles depend on the order in which
    parts meet, and sums of floats may, so rows and cuts are each written once: rows and the ranges' sums see the same.
    Amounts are not negative. total: name of a column for the sum over a group.
    """
    df = cut(df)
    return _running(df, quantiles(df, value, amount, by, total), value, amount, by, name, descending, least)


def quantiles(df: DataFrame, value: str, amount: str, by: Sequence[str], total: str | None = None) -> DataFrame:
    """(by, _cuts, total): each group's values that part its ranges, about equally full, written once."""
    shares = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    some = F.when(F.col(amount) >= 0, F.col(value))
    return cut(df.groupBy(*by).agg(F.percentile_approx(some, shares, F.lit(1000)).alias("_cuts"), *([F.sum(amount).alias(total)] if total else [])))


def _running(df: DataFrame, cuts: DataFrame, value: str, amount: str, by: Sequence[str], name: str, descending: bool, least: bool) -> DataFrame:
    """running() by cuts that are given; any cuts give the same sums."""
    few = (lambda t: F.broadcast(t)) if cuts.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS else (lambda t: t)
    p = df.join(few(cuts), [*by]) if by else df.crossJoin(F.broadcast(cuts))  # without groups one row
    p = p.withColumn("_p", F.coalesce(F.size(F.filter("_cuts", lambda c: F.col(value) > c)), F.lit(0))).drop("_cuts")
    up_to = F.min if least else F.sum
    turn = (lambda c: F.col(c).desc()) if descending else F.col
    rows = Window.partitionBy(*by, "_p").orderBy(turn(value), F.col(amount).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = p.groupBy(*by, "_p").agg(up_to(amount).alias("_a"))
    ends = ends.withColumn("_b", up_to("_a").over(Window.partitionBy(*by).orderBy(turn("_p")).rowsBetween(Window.unboundedPreceding, -1))).drop("_a")
    out = p.withColumn(name, up_to(amount).over(rows)).join(few(ends), [*by, "_p"])
    whole = F.least(name, "_b") if least else F.col(name) + F.coalesce("_b", F.lit(0))
    return out.withColumn(name, whole).drop("_p", "_b")


def medians(steps: DataFrame, by: Sequence[str], lower: bool = False) -> DataFrame:
    """(by, median) of values that stand m times each, (by, value, m): exact, as the mean of the two in the middle, or the lower of them."""
    r = running(steps, "value", "m", by, "_u", total="_n")
    low, high = (F.min(F.when(c, F.col("value"))) for c in (2 * F.col("_u") >= F.col("_n"), 2 * F.col("_u") > F.col("_n")))
    return r.groupBy(*by).agg((low if lower else (low + high) / 2).alias("median"))


def draw_order(values: DataFrame) -> DataFrame:
    """(cell_id, value, weight, place): the place, from 1, in which cells are drawn, later ones on top.

    Order is by weight (highlighted cells last), then by value, then by cell. Weights are few.
    """
    placed = positions(values, "value", "cell_id", ["weight"])
    below = values.groupBy("weight").agg(F.count("*").alias("_c"))
    below = below.select("weight", (F.sum("_c").over(Window.orderBy("weight")) - F.col("_c")).alias("_w"))
    return placed.join(F.broadcast(below), "weight").select("cell_id", "value", "weight", (F.col("_k") + F.col("_w") + 1).alias("place"))


def kth(df: DataFrame, column: str, ks: Sequence[int], n: int) -> list[float]:
    """The values at places ks (from 0) of a numeric column of n values, exactly.

    Approximate quantiles bracket each place; values below the bracket are counted and those within, a
    few thousandths of all, are sorted.
    """
    out = []
    for k in ks:
        lo, hi = df.stat.approxQuantile(column, [max(0.0, k / n - 0.003), min(1.0, (k + 1) / n + 0.003)], 0.001)
        below = df.where(F.col(column) < lo).count()
        out.append(df.where(F.col(column).between(lo, hi)).select(column).orderBy(column).offset(k - below).limit(1).first()[0])
    return out


def cell_order(obs: DataFrame, category: str | None = None, categories: Sequence[str] = (), position: DataFrame | None = None, distance: bool = False) -> DataFrame:
    """(cell_id, ord) for a heatmap: as they stand, by category, by place on or distance from a line, or by category and then place.

    position: (cell_id, position, distance) of a projection; places are below 1, so a category's number leaves them room.
    """
    value = F.lit(0.0)
    out = obs
    if position is not None:
        out = out.join(position.select("cell_id", "position", "distance"), "cell_id")
        value = F.col("distance") if distance else F.col("position")
    if category is not None:
        rank = F.coalesce(F.array_position(F.array(*(F.lit(c) for c in categories)), F.col(category)), F.lit(0))
        value = F.when(rank == 0, F.lit(float(len(categories)))).otherwise((rank - 1).cast("double")) * 2 + value
    elif position is None:
        value = F.col("cell_id").cast("double")
    return out.select("cell_id", value.alias("ord"))
