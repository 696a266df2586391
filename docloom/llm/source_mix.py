"""Mixing sources to target weights by entropy balancing.

Wanted are document rates w of least sum of w log w - w whose tokens meet each source's target and of which none
exceeds ``most``. The convex dual has one multiplier for each source, and a document's rate is its exponential
tilt min(most, exp(multiplier * size)). Newton steps solve the dual: each sums the tilted tokens (gradient) and
size * size * rate of the documents below the cap (curvature) of all sizes, and moves every multiplier by
target less tokens over curvature, within a bracket that each step narrows. Sources above their target thus
give up long documents first, sources below it repeat long documents more.

Rates become copies: the whole part, and one more for the documents that a systematic draw hits. The draw
runs by rank within cells (source, size class, salt), so that documents of all sizes are hit in proportion; of
several sets of starts a source takes the one whose tokens come nearest to its target. What then lacks or
exceeds is mended by single documents: in each of FIXES rounds every source adds or drops one copy of the
document whose size is nearest to what is off.

A rate depends on source and size alone, so Newton reads counts by (source, size). Cells have about CELL
documents at most and are salted by id and text, so that a source with a third of all rows, or rows without
id, are spread over many tasks; only rows that agree in both stay together. Rows that travel hold ids and
sizes only. Sources are a dimension: their table has one row for each.

Defined results: a null text has size 0; a null source is a source of its own, last in order; sources
without tokens get target 0; documents without words are never taken; in an empty table nothing is taken. One
source gets what it has. Repeated rows are mixed each on its own; those that agree in id, text and source are
told apart by no order, but any order gives the same rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.columns import WORD, pick
from docloom.llm.storage import Scratch

#: Documents of a cell, about, at most.
CELL = 400
#: Size classes for each doubling of the size.
CLASSES = 4
#: Sets of starts that are tried, and rounds of mending.
DRAWS, FIXES = 16, 4
MOST = 3
WEIGHTS = (1, 2, 3)


def sized(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size in words, salt (hash of id and text); nothing of the text goes on."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return pick(df, doc_id=key, source=source, text=text).select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("hash"))


def placed(per: DataFrame, scratch: Scratch) -> DataFrame:
    """per with place, from 0, by code point of the source, null last: sorted by range, and counted by partition."""
    ranged = per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = scratch.save(ranged, "ranged")
    before, base = 0, []
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").count().collect()):
        base.append((part, before))
        before += n
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    starts = per.sparkSession.createDataFrame(base, "part int, base long")
    return ranged.withColumn("inside", inside).join(F.broadcast(starts), "part").withColumn("place", F.col("base") + F.col("inside")).drop("part", "base", "inside")


def targets(sizes: DataFrame, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, n, least (its smallest size above 0), target: shares of all tokens by weight, none above most times its source; what is above goes to the others by weight, until none is above.

    That is the level L with the sum of min(most * size, weight * L) equal to all tokens; each round settles the sources that the level exceeds.
    """
    scratch = Scratch(sizes.sparkSession, "targets")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    per = scratch.save(placed(per, scratch).withColumn("weight", weight).drop("place"), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, open_weight = 0.0, None
    while total:
        full = cap <= F.col("weight") * F.lit(level)
        held, w = per.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0))).first()
        if not w or w == open_weight:
            break
        level, open_weight = (total - held) / w, w
    return per.select("source", "source_size", "n", "least", F.least(cap, F.col("weight") * F.lit(float(level))).alias("target"))


def tilt(multiplier: Column, size: Column, most: float) -> Column:
    return F.least(F.exp(F.least(multiplier * size, F.lit(50.0))), F.lit(float(most)))


def multipliers(sizes: DataFrame, goals: DataFrame, most: float = MOST, tolerance: float = 1e-9, steps: int = 100) -> DataFrame:
    """source, source_size, target, multiplier (null: all of the source's documents at the cap), off: Newton on the dual. Each step reads all counts by source and size; only whether it has converged comes to the driver."""
    scratch = Scratch(sizes.sparkSession, "newton")
    counts = scratch.save(sizes.where("size > 0").groupBy(F.col("source").alias("of"), "size").agg(F.count("*").alias("docs")), "counts")
    # the multiplier of a source lies between these: all documents tilted as the smallest is would be too little, or too much
    ratio = F.try_divide("target", "source_size")
    end = F.when(ratio < 1, F.log(ratio)).otherwise(math.log(most)) / F.col("least")
    open_ones = (F.col("target") > 0) & (ratio < most * (1 - 1e-12))
    now = goals.select("source", "source_size", "target", F.when(open_ones, F.lit(0.0)).alias("multiplier"), F.least(end, F.lit(0.0)).alias("low"), F.greatest(end, F.lit(0.0)).alias("high"))
    now = scratch.save(now.withColumn("off", F.lit(0.0)), "start")
    size, at = F.col("size"), F.col("multiplier")
    for step in range(steps):
        rate = tilt(at, size, most)
        dual = now.where("multiplier is not null").select("source", "multiplier")
        sums = counts.join(dual, F.col("source").eqNullSafe(F.col("of"))).groupBy("of").agg(F.sum(F.col("docs") * size * rate).alias("tokens"), F.sum(F.when(rate < most, F.col("docs") * size * size * rate).otherwise(0.0)).alias("curvature"))
        met = now.drop("off").join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
        short = F.col("target") - F.col("tokens")
        met = met.withColumn("low", F.when(short > 0, at).otherwise(F.col("low"))).withColumn("high", F.when(short < 0, at).otherwise(F.col("high")))
        jump = at + F.try_divide(short, F.col("curvature"))
        within = (jump >= F.col("low")) & (jump <= F.col("high"))
        middle = (F.col("low") + F.col("high")) / 2
        off = F.coalesce(F.try_divide(F.abs(short), F.col("target")), F.lit(0.0))
        moved = F.when(off < tolerance, at).when(at.isNotNull(), F.when(within, jump).otherwise(middle))
        now = scratch.save(met.select("source", "source_size", "target", moved.alias("multiplier"), "low", "high", off.alias("off")), f"step{step}")
        scratch.drop(f"step{step - 1}" if step else "start")
        if (now.agg(F.max("off")).first()[0] or 0.0) < tolerance:
            break
    return now.select("source", "source_size", "target", "multiplier", "off")


def mix(df: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (size times copies), rate, source, for each row."""
    scratch = Scratch(df.sparkSession, "mix")
    sizes = scratch.save(sized(df, key, source, text), "sizes")
    goals = scratch.save(multipliers(sizes, targets(sizes, most, weights), most).drop("off"), "goals").withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    size_class = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")) * CLASSES).cast("int")
    classes = sizes.groupBy("source", size_class.alias("class")).agg(F.count("*").alias("in_class"))
    classes = scratch.save(classes.select(F.col("source").alias("of"), F.col("class").alias("of_class"), F.ceil(F.col("in_class") / CELL).cast("int").alias("salts")), "classes")
    named = sizes.withColumn("class", size_class).join(classes, same & (F.col("class") == F.col("of_class"))).drop("of", "of_class")
    named = named.withColumn("salt", F.pmod(F.xxhash64("hash"), F.col("salts")).cast("int")).drop("salts")
    cell = Window.partitionBy("source", "class", "salt").orderBy("size", "hash", "doc_id")
    ranked = named.withColumn("rank", F.row_number().over(cell)).drop("hash")
    # a rate that Newton leaves a hair under a whole number is that number
    rate = F.when((F.col("target") > 0) & (F.col("size") > 0), F.coalesce(tilt(F.col("multiplier"), F.col("size"), most), F.lit(float(most)))).otherwise(0.0)
    whole = F.least(F.floor(F.col("rate") + 1e-7), F.lit(most))
    ready = ranked.join(goals, same).withColumn("rate", rate).withColumn("whole", whole).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    ready = scratch.save(ready.drop("of", "multiplier"), "placed")
    scratch.drop("sizes", "classes", "goals")

    def extra(draw: Column) -> Column:
        start = F.pmod(F.xxhash64(draw, F.col("class"), F.col("salt")), F.lit(1_000_000)) / 1_000_000
        return F.floor(F.col("part") * F.col("rank") + start) - F.floor(F.col("part") * (F.col("rank") - 1) + start)

    tried = ready.groupBy("source").agg(F.first("target").alias("goal"), *[F.sum(F.col("size") * (F.col("whole") + extra(F.lit(k)))).alias(f"t{k}") for k in range(DRAWS)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("goal")).alias("off"), F.lit(k).alias("draw"), (F.col(f"t{k}") - F.col("goal")).alias("over")) for k in range(DRAWS)]))
    draws = scratch.save(tried.select(F.col("source").alias("of"), nearest["draw"].alias("draw"), nearest["over"].alias("over")), "draws")
    copies = F.least(F.col("whole") + extra(F.col("draw")), F.lit(math.floor(most))).cast("long")
    now = ready.join(draws, same).withColumn("copies", copies).drop("of", "draw", "over", "whole", "part")
    now = scratch.save(now, "drawn")
    over, mended = draws.select("of", "over"), None
    for k in range(FIXES):
        # a copy less where there are too many words, one more where they lack: whichever leaves least
        change = F.when(F.col("over") > 0, -1).otherwise(1)
        can = (F.col("size") > 0) & F.when(F.col("over") > 0, F.col("at") > 0).otherwise((F.col("at") < most) & (F.col("rate") > 0))
        at = now.withColumn("at", F.col("copies"))
        if mended is not None:
            at = _changed(at, mended)
        left = F.abs(F.col("over") + change * F.col("size"))
        best = at.join(over, same).where(can & (left < F.abs("over"))).groupBy("source").agg(F.min(F.struct(left.alias("left"), "size", "class", "salt", "rank", change.alias("change"), (F.col("over") + change * F.col("size")).alias("after"))).alias("m"))
        best = scratch.save(best.select(F.col("source").alias("of"), "m.*"), f"fix{k}")
        mended = best if mended is None else mended.unionByName(best)
        over = scratch.save(over.join(best.select(F.col("of").alias("source"), "after"), same, "left").select("of", F.coalesce("after", "over").alias("over")), f"over{k}")
    out = _changed(now.withColumn("at", F.col("copies")), mended) if mended is not None else now.withColumn("at", F.col("copies"))
    return out.select("doc_id", "size", "source_size", "target", F.col("at").alias("copies"), (F.col("size") * F.col("at")).alias("taken"), "rate", "source")


def _changed(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """rows with the sum of all fixes of a row added to at. There are at most FIXES fixes for each source."""
    per = fixes.groupBy(F.col("of"), F.col("class").alias("of_class"), F.col("salt").alias("of_salt"), F.col("rank").alias("of_rank")).agg(F.sum("change").alias("by"))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class")) & (F.col("salt") == F.col("of_salt")) & (F.col("rank") == F.col("of_rank"))
    return rows.join(per, same, "left").withColumn("at", F.col("at") + F.coalesce("by", F.lit(0))).drop("of", "of_class", "of_salt", "of_rank", "by")
