"""Mixing sources to target weights (operator 10): systematic sampling inside each source.

Every document of a source has the same expected number of copies, rate = target / source size.
Documents of a source are put in a fixed order; document number i (from 0) stands for the
interval [i * rate, (i + 1) * rate) and is emitted once for each integer boundary that the
interval crosses after one offset in [0, 1), drawn per source, has been added.  The order is by size class, so
small and long documents are drawn alike and the words taken differ from the target by a few
documents at most.

The number of a document is exact and needs no global sort and no large group: counts of the
cells (source, size class, hash slice) are prefix-summed (at most ``64 * SLICES`` rows a source,
whatever the input), and rows are numbered inside their cell only.

Edge cases: null text or source sizes are 0 / a source of its own, last in order; a source
without words has target 0 and none of its documents is taken; repeated rows are separate
documents; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
SLICES = 1024
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    """Integer below 2**32 from an md5 (the same in any engine)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, limit: float = LIMIT,
            weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> the same with ``target``: weights repeat over the sources in
    code-point order, null last; a target is at most ``limit`` times its source, and what a source
    cannot take is shared again by weight.

    One row a source.  All targets are min(limit * size, level * weight): sources leave the
    sharing in order of limit * size / weight, and the level is the first at which the next one
    has room.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    k = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("most", limit * F.col("source_size"))
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (
        share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # the first source, in that order, that is not filled at the level offered to it
    roomy = F.col("level") * F.col("weight") <= F.col("most")
    s = s.withColumn("final", F.min(F.when(
        roomy, F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(every)["level"])
    return s.select("source", "source_size", F.coalesce(
        F.least("most", F.col("final") * F.col("weight")), F.col("most")).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
        share: float = SHARE, limit: float = LIMIT, weights: tuple[float, ...] = WEIGHTS,
        seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """One row a document: the columns ``keep`` (all when None) with mix_size, mix_source_size,
    mix_target and mix_copies (how often the mix takes the document)."""
    cols = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    d = docs.select(*cols, n_words(F.col(text)).alias("mix_size"), F.col(source).alias("__source"),
                    F.col(doc_id).cast("string").alias("__id"))
    # size class, 4 an octave: length and the two bits after the first of size + 4
    bits = F.bin(F.col("mix_size") + 4)
    d = d.withColumns({
        "__class": 4 * F.length(bits) + F.conv(F.substring(bits, 2, 2), 2, 10).cast("int"),
        "__hash": _hash(F.lit(seed), F.coalesce("__id", F.lit("null"))),
    }).withColumn("__slice", (F.col("__hash") % SLICES).cast("int"))
    cells = d.groupBy("__source", "__class", "__slice").agg(
        F.count(F.lit(1)).alias("n"), F.sum("mix_size").alias("size"))
    per_source = targets(cells.groupBy(F.col("__source").alias("source")).agg(
        F.sum("size").alias("source_size")), share, limit, weights)
    walk = (Window.partitionBy("__source").orderBy("__class", "__slice")
            .rowsBetween(Window.unboundedPreceding, -1))
    cells = (cells.withColumn("__before", F.coalesce(F.sum("n").over(walk), F.lit(0)))
             .join(per_source, F.col("__source").eqNullSafe(F.col("source"))).select(
                 F.col("__source").alias("__s"), F.col("__class").alias("__c"), F.col("__slice").alias("__l"), "__before",
                 F.col("source_size").alias("__source_size"), F.col("target").alias("__target")))
    cell = Window.partitionBy("__source", "__class", "__slice").orderBy("mix_size", "__hash", "__id")
    d = d.withColumn("__at", F.row_number().over(cell) - 1)
    d = d.join(cells, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__class") == F.col("__c"))
               & (F.col("__slice") == F.col("__l")))
    offset = _hash(F.lit(seed), F.coalesce("__source", F.lit("null"))) / F.lit(float(1 << 32))
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    number = F.col("__before") + F.col("__at")
    copies = F.floor(offset + (number + 1) * rate) - F.floor(offset + number * rate)
    return d.select(*cols, "mix_size", F.col("__source_size").alias("mix_source_size"),
                    F.col("__target").alias("mix_target"),
                    F.least(copies, F.lit(int(limit)).cast("long")).alias("mix_copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, numbered from 0 in ``mix_copy``."""
    n = F.col("mix_copies").cast("int")
    return mixed.where(n > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(0), n - 1)))
