"""Exact global order without a single-task sort: rows at given ranks, tiles, bins, running sums.

Everything is a lazy plan without a driver job.  Rows are dealt into ``RANGES`` ranges of their (value, tie) keys.
The ends of the ranges come from a sample of about ``SAMPLE`` keys, those whose hash is below a bound that follows from the
number of rows; so they adapt to any distribution (heavy tails, values that differ in their last bits only, a value that a
third of all rows share, which the tie splits), a range holds about 1 / ``RANGES`` of the rows, and the sample is the same whenever it is
evaluated.  All counts and sums are over all rows: per range first (at most ``RANGES`` rows after map-side combining, which one small window
sums up), then inside a range.  What is taken over from one step to the next are exact facts (the smallest and largest
key of a range, the rows before it), so the sample decides the balance and never the result.

Tiles and bins need only the k - 1 rows at their upper ends: they are found first, as a scalar
subquery, and every row is then compared with them in a projection, without a window or a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retainr.functions.columns import col

STEP = 32
RANGES = STEP * STEP
SAMPLE = 64 * RANGES
DRAW = 1 << 40


def ntile_end(n: Column, j: int, k: int) -> Column:
    """Last rank of tile j of SQL ``NTILE(k)`` over n rows."""
    return j * F.floor(n / k) + F.least(F.lit(j), n % k)


def quantile_bin_end(n: Column, j: int, k: int) -> Column:
    """Last rank of bin j of pandas ``qcut`` over n distinct ranks; a single row is in bin 1."""
    return F.floor((n - 1) * j / k) + 1


def with_range(rows: DataFrame, order: str, key: str, out: str, keys: DataFrame | None = None) -> DataFrame:
    """Add the number (0 .. RANGES - 1) of a row's range among the rows with its ``order``: monotone in ``key``.

    Ranges hold equally many of ``keys`` (order, key), the rows themselves by default."""
    keys = rows if keys is None else keys
    counts = keys.groupBy(order).agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct(order, "n")))).scalar()
    draw = F.pmod(F.xxhash64(order, key), F.lit(DRAW)).cast("double")
    sample = keys.withColumn("__n", counts).where(draw * F.try_element_at("__n", col(order)) < float(SAMPLE * DRAW))
    # one row an order, of about SAMPLE keys; then RANGES - 1 keys, and every STEP-th of them
    ends = sample.groupBy(order).agg(F.sort_array(F.collect_list(key)).alias("s")).select(order, F.transform(
        F.sequence(F.lit(1), F.lit(RANGES - 1)),
        lambda i: F.element_at("s", (F.floor(i * F.size("s") / RANGES) + 1).cast("int"))).alias("ends")).select(order, "ends", F.transform(
            F.sequence(F.lit(1), F.lit(STEP - 1)), lambda i: F.element_at("ends", i * STEP)).alias("coarse"))
    found = ends.agg(F.map_from_entries(F.collect_list(F.struct(order, F.struct("ends", "coarse"))))).scalar()

    def below(ends: Column) -> Column:
        return F.coalesce(F.size(F.filter(ends, lambda e: e <= col(key))), F.lit(0))

    first = rows.withColumn("__ends", found).withColumn("__ends", F.try_element_at("__ends", col(order))).withColumn(
        "__at", STEP * below(col("__ends.coarse")))
    inside = F.slice("__ends.ends", col("__at") + 1, STEP - 1)
    return first.withColumn(out, col("__at") + below(inside)).drop("__ends", "__at")


def rows_at_ranks(df: DataFrame, values: list[Column], tie: Column | None,
                  ranks: Callable[[Column], list[Column]]) -> Column:
    """Rows at the 1-based ``ranks(n)`` of several orders of ``df`` at once, as a scalar Column to be added to a
    DataFrame once and read with ``at_rank``.

    Each of ``values`` is an order, ascending with ties by ``tie``; all have one type, and null values count as no rows.
    The tie should differ between the rows of a value, as an id does, because a range cannot cut equal (value, tie) keys; without a tie
    the rows of a value are counted before they are shuffled, and the value at a rank is all that is meant."""
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), v.alias("v")) for o, v in enumerate(values)]))
    if tie is None:
        rows = df.select(each.alias("e")).where("e.v IS NOT NULL").groupBy("e.o", "e.v").agg(F.count(F.lit(1)).alias("m")).select(
            "o", F.struct("v", F.lit(0).cast("long").alias("u")).alias("k"), "m")
    else:
        rows = df.select(tie.alias("u"), each.alias("e")).where("e.v IS NOT NULL").select(
            "e.o", F.struct("e.v", "u").alias("k"), F.lit(1).cast("long").alias("m"))
    whole = Window.partitionBy("o")
    counted = with_range(rows, "o", "k", "b").groupBy("o", "b").agg(
        F.sum("m").alias("m"), F.min("k").alias("lo"), F.max("k").alias("hi")).select(
        "o", "lo", "hi", "m", F.sum("m").over(whole).alias("n"), (F.sum("m").over(whole.orderBy("b")) - col("m")).alias("before"))
    asked = F.explode(F.array(*[
        F.struct(F.lit(j).alias("j"), r.cast("long").alias("r")) for j, r in enumerate(ranks(col("n")))]))
    # at most one range for each order and rank: bounded by the call, not by the data
    wanted = counted.select("o", "lo", "hi", "n", "before", "m", asked.alias("a")).where(
        (col("a.r") > col("before")) & (col("a.r") <= col("before") + col("m"))).select(
        "o", "lo", "hi", "n", col("a.j").alias("j"), (col("a.r") - col("before")).alias("r"))
    inside = rows.join(F.broadcast(wanted), "o").where((col("k") >= col("lo")) & (col("k") <= col("hi"))).withColumn(
        "to", F.sum("m").over(Window.partitionBy("o", "j").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    entry = F.struct((col("o") * 1000 + col("j")).alias("key"), F.struct("k.v", "k.u", "n").alias("value"))
    return inside.where((col("to") - col("m") < col("r")) & (col("r") <= col("to"))).agg(
        F.map_from_entries(F.collect_list(entry)).alias("rows")).scalar()


def at_rank(found: str, order: int, rank: int) -> Column:
    """(v, u, n) of a column made by ``rows_at_ranks``: value and tie of the row at that rank (number in the
    list, from 0) and the number of rows; null if the order has no such rank."""
    return F.try_element_at(col(found), F.lit(order * 1000 + rank))


def with_tiles(df: DataFrame, values: dict[str, Column], tie: Column, k: int, end=ntile_end) -> DataFrame:
    """Add for each ``out -> integer column`` the tile (1..k) of a row in ascending (value, tie) order: ``NTILE(k)``
    (W02), or the bins of ``qcut(rank(method='first'), k)`` (W04) with ``end=quantile_bin_end``."""
    ends = rows_at_ranks(df, list(values.values()), tie,
                         lambda n: [end(n, j, k) for j in range(1, k)])

    def above(o: int, value: Column) -> Column:
        tile = F.lit(1)
        for j in range(k - 1):  # one more for each tile end below the row
            e = at_rank("__ends", o, j)
            below = (e["v"] < value) | ((e["v"] == value) & (e["u"] < tie))
            tile = tile + F.coalesce(below, F.lit(False)).cast("int")
        return tile

    return df.withColumn("__ends", ends).withColumns(
        {out: above(o, v) for o, (out, v) in enumerate(values.items())}).drop("__ends")


def running_sums(df: DataFrame, key: Column, weights: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """Add ``out -> weight`` inclusive running sums of integer columns in ascending order of the (distinct) ``key``,
    and ``totals``: out -> weight sums over all rows.

    Two levels: the largest key and the sums of each range come as one scalar subquery (``RANGES`` entries at most); a row finds its range
    among these keys, and running sums inside it start from the sums of the ranges before."""
    totals = totals or {}
    names = sorted({*weights.values(), *totals.values()})
    d = df.withColumns({"__o": F.lit(0), "__key": key})
    ranges = with_range(d.select("__o", "__key", *names), "__o", "__key", "__c").groupBy("__c").agg(
        F.max("__key").alias("last"), *[F.sum(w).alias(w) for w in names])
    so_far = Window.orderBy("__c")  # RANGES rows at most
    ranges = ranges.select("last", *[(F.sum(w).over(so_far) - col(w)).alias(f"b_{w}") for w in names], *names)
    facts = ranges.agg(F.sort_array(F.collect_list(F.struct("last", *[f"b_{w}" for w in names]))).alias("r"),
                       *[F.sum(w).alias(w) for w in names])
    facts = facts.select(F.struct(  # a field of an array of structs is the array of that field
        col("r")["last"].alias("lasts"), F.filter("r", lambda x, i: (i + 1) % STEP == 0)["last"].alias("coarse"),
        *[col("r")[f"b_{w}"].alias(f"b_{w}") for w in names], *names)).scalar()

    def below(ends: Column) -> Column:
        return F.size(F.filter(ends, lambda e: e < col("__key")))

    d = d.withColumn("__f", facts).withColumn("__at", STEP * below(col("__f.coarse")))
    d = d.withColumn("__c", col("__at") + below(F.slice("__f.lasts", col("__at") + 1, STEP - 1)))
    d = d.select(*df.columns, "__key", "__c", *[F.get(f"__f.b_{w}", col("__c")).alias(f"__b_{w}") for w in {*weights.values()}],
                 *[col(f"__f.{w}").alias(o) for o, w in totals.items()])
    inside = Window.partitionBy("__c").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
    return d.select(*df.columns, *[(col(f"__b_{w}") + F.sum(w).over(inside)).alias(o) for o, w in weights.items()], *totals)
