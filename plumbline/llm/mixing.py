"""Mixing sources to target weights by entropy balancing.

Every source gets its target of tokens exactly, and the lengths of what is
taken are drawn towards one mean for all sources: of all rates up to MOST, the
ones sought have the least relative entropy per token plus a penalty (SOFT) on
how far the source's mean log length, counted in tokens, stays from that of the
whole corpus.  They are exponentials of two multipliers, lam and gam, of the
source: rate = exp(lam + gam * (log length - mean)), at most MOST.  The concave
dual of a source is

    lam * target - sum of tokens * P(lam + gam z) - SOFT * target * gam^2 / 2

with P' the rate.  It is climbed by Newton steps from gam = 0, halved where the
dual falls; one pass over a table of (source, size) counts sums the dual, its
slope and its curvature for all sources at once.

Rates are then rounded into whole copies: every document gets the whole part,
and the fraction is given to the documents that a hash picks, from long
documents to short ones, each class of sizes making up for what the one before
left over.  Copies depend only on doc_id, source, size and, for rows equal in
these, on which of them it is; so such rows are taken apart, and reruns agree.

Defined results: a null text has size 0 and is never taken; null is a source
like others and sorts last; a source whose target is MOST times its size is
taken MOST times; an empty table gives no rows; columns not named are not read
or, in ``repeat``, passed through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Least sizes of the classes that are rounded one after the other.
CLASSES = (2048, 512, 128, 32, 0)
SOFT = 0.5
STEPS, PRECISION = 100, 1e-10
#: Bins of a hash in which the edge between taken and not is sought, and parts of the bin at which the last class stops.
BINS = 1024


def source_key(source: Column) -> Column:
    """The source as a string that is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def sizes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", whole: bool = False) -> DataFrame:
    """doc_id, source, key and size (words) of every row and, if ``whole``, the row itself."""
    words = F.coalesce(F.regexp_count(F.col(text_column), F.lit(common.WORD)), F.lit(0)).cast("long")
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole else []
    return docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), source_key(F.col(source_column)).alias("key"), words.alias("size"), *row)


def measured(docs: DataFrame, **options) -> DataFrame:
    """``sizes``, written once, with ``copy``: which of the rows equal in doc_id, source and size it is."""
    rows = common.numbered(sizes(docs, **options), "sizes", "number")
    return common.occurrences(rows, ["doc_id", "key", "size"], "number", "copy").drop("number")


def targets(histogram: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """key, source_size, target: one row for each source.

    A source whose share passes ``most`` times its size stops there; the excess
    goes to the others by weight.  In order of size over weight the stopped
    sources come first, and one is stopped if it passes while those before are.
    """
    held = histogram.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    held = held.withColumn("weight", weight).withColumn("stop", most * F.col("source_size"))
    order = Window.orderBy(F.col("stop") / F.col("weight"), "key")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total, mass = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    level = (total - zero(F.sum("stop").over(before))) / (mass - zero(F.sum("weight").over(before)))
    held = held.withColumn("stopped", F.col("stop") < level * F.col("weight")).withColumn("total", total)
    stopped = F.sum(F.when(F.col("stopped"), F.col("stop")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("stopped"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("stopped"), F.col("stop")).otherwise((F.col("total") - stopped) * F.col("weight") / open_weight)
    return held.select("key", "source_size", F.least(target, F.col("stop")).cast("double").alias("target"))


def _rate(most: float) -> Column:
    return F.least(F.exp(F.col("lam") + F.col("gam") * (F.log1p("size") - F.col("centre"))), F.lit(most))


def balance(histogram: DataFrame, wanted: DataFrame, most: float = MOST, soft: float = SOFT) -> DataFrame:
    """``wanted`` with the multipliers lam and gam of each source, the mean log length and the number of steps.

    Of a step, the driver sees the largest relative error.
    """
    token, size, top = F.col("size") * F.col("n"), F.log1p("size"), math.log(most)
    cells = common.materialise(histogram.where("size > 0").groupBy("key", "size").agg(F.sum("n").alias("n")), "cells")
    centre = cells.agg(F.sum(token * size) / F.sum(token)).first()[0] or 0.0
    # The solution where all lengths are alike; a source taken MOST times has no other.
    start = F.when(F.col("target") > 0, F.log(F.col("target") / F.col("source_size"))).otherwise(0.0)
    settled = (F.col("target") <= 0) | (F.col("target") >= most * F.col("source_size") * (1 - 1e-12))
    zero = F.lit(0.0)
    state = wanted.withColumns({"settled": settled, "lam": start, "gam": zero, "best": F.lit(float("-inf")), "lam_step": zero, "gam_step": zero, "error": F.when(settled, 0.0).otherwise(1.0)})
    steps = 0
    while True:
        state = common.materialise(state, "multipliers")
        if steps == STEPS or (state.agg(F.max("error")).first()[0] or 0.0) <= PRECISION:
            break
        steps += 1
        tried = state.withColumns({"lam_try": F.col("lam") + F.col("lam_step"), "gam_try": F.col("gam") + F.col("gam_step")})
        z = size - F.lit(centre)
        rows = cells.join(tried.where("not settled").select("key", "lam_try", "gam_try"), "key").withColumns({"z": z, "u": F.col("lam_try") + F.col("gam_try") * z})
        rows = rows.withColumn("e", F.exp(F.least("u", F.lit(top))))
        slope = F.when(F.col("u") < top, F.col("e")).otherwise(0.0)
        sums = rows.groupBy("key").agg(
            F.sum(token * (F.col("e") + most * F.greatest(F.col("u") - top, zero))).alias("area"),
            F.sum(token * F.col("e")).alias("g0"),
            F.sum(token * F.col("e") * F.col("z")).alias("g1"),
            *(F.sum(token * slope * F.pow("z", F.lit(float(k)))).alias(f"h{k}") for k in range(3)),
        )
        target = F.col("target")
        joined = tried.join(sums, "key", "left").withColumns(
            {
                "dual": F.col("lam_try") * target - F.col("area") - soft / 2 * target * F.col("gam_try") * F.col("gam_try"),
                "e0": target - F.col("g0"),
                "e1": -F.col("g1") - soft * target * F.col("gam_try"),
                # Where all rates are at MOST there is no curvature; a little keeps the step finite.
                "c0": F.col("h0") + 1e-9 * target,
                "c2": F.col("h2") + soft * target,
            }
        )
        det = F.col("c0") * F.col("c2") - F.col("h1") * F.col("h1")
        joined = joined.withColumns({"s0": (F.col("e0") * F.col("c2") - F.col("e1") * F.col("h1")) / det, "s1": (F.col("e1") * F.col("c0") - F.col("e0") * F.col("h1")) / det})
        short = 1 / F.greatest(F.lit(1.0), F.abs("s0"), F.abs("s1"))
        better = F.col("dual") >= F.col("best") - 1e-13 * (F.abs("area") + F.abs(F.col("lam_try") * target))
        pick = lambda new, old: F.when(F.col("settled"), F.col(old)).when(better, new).otherwise(F.col(old))
        half = lambda step, name: F.when(F.col("settled"), 0.0).when(better, step * short).otherwise(F.col(name) / 2)
        state = joined.select(
            *wanted.columns, "settled", pick(F.col("lam_try"), "lam").alias("lam"), pick(F.col("gam_try"), "gam").alias("gam"), pick(F.greatest("dual", "best"), "best").alias("best"),
            half(F.col("s0"), "lam_step").alias("lam_step"), half(F.col("s1"), "gam_step").alias("gam_step"), pick(F.greatest(F.abs("e0"), F.abs("e1")) / target, "error").alias("error"),
        )
    # Sums of doubles depend on their order in the last digits; copies should not.
    return state.select(*wanted.columns, F.round("lam", 9).alias("lam"), F.round("gam", 9).alias("gam"), F.lit(centre).alias("centre"), F.lit(steps).alias("steps"))


def _parts(most: float) -> dict[str, Column]:
    """whole and fraction of a row's rate, its class, and the place (bin and part of it) in the order in which fractions are given."""
    rate = _rate(most)
    near = F.when(F.abs(rate - F.round(rate)) < 1e-6, F.round(rate)).otherwise(rate)
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "key", "size", "copy"), 11) / F.lit(float(1 << 53))
    level = F.lit(len(CLASSES) - 1)
    for n in range(len(CLASSES) - 2, -1, -1):
        level = F.when(F.col("size") >= CLASSES[n], F.lit(n)).otherwise(level)
    order = F.try_divide(unit, near - F.floor(near)) * BINS
    bin_ = F.least(F.floor(order), F.lit(2 * BINS - 1))
    return {"whole": F.floor(near), "fraction": near - F.floor(near), "class": level, "bin": bin_, "part": F.least(F.floor((order - bin_) * BINS), F.lit(BINS - 1))}


def _taken(cells: Column, left: Column) -> Column:
    """Of (place, held) in order, the place up to which all fit: a cell is taken if more than half of it is still due."""
    step = lambda s, x: F.when(s["open"] & (x["held"] / 2 <= s["left"]), F.struct(F.lit(True).alias("open"), (s["left"] - x["held"]).alias("left"), (x["place"] + 1).alias("edge"))).otherwise(F.struct(F.lit(False).alias("open"), s["left"].alias("left"), s["edge"].alias("edge")))
    return F.aggregate(cells, F.struct(F.lit(True).alias("open"), left.cast("double").alias("left"), F.lit(0).cast("long").alias("edge")), step)


def thresholds(rows: DataFrame, state: DataFrame, most: float = MOST) -> DataFrame:
    """``state`` with ``edges`` (of each class of sizes, the bin up to which a copy more is given), and ``last``, ``stop`` and ``upto``: the source's last class, the bin at which it stops, and the part of that bin up to which it goes on.

    A source's bins are 2 BINS a class at most and the parts of one bin are
    BINS, whatever the corpus; they are walked in one pass.
    """
    marked = rows.join(state, "key").withColumns(_parts(most)).where("size > 0 and fraction > 0")
    # Dues are summed as whole numbers, so that no order of adding them matters.
    marked = marked.select("key", "class", F.col("bin").cast("long"), F.col("part").cast("long"), "size", F.round(F.col("size") * F.col("fraction") * 1024).cast("long").alias("due"))
    marked = common.materialise(marked, "fractions")
    bins = marked.groupBy("key", "class", "bin").agg(F.sum("size").alias("held"), F.sum("due").alias("due"))
    sources = bins.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("class", F.col("bin").alias("place"), "held", "due"))).alias("cells"))
    names = range(len(CLASSES))
    own = lambda n: F.filter("cells", lambda x: x["class"] == n)
    sources = sources.withColumns({f"cells{n}": own(n) for n in names}).withColumn("left", F.lit(0.0))
    for n in names:  # one class makes up for what the one before left over
        due = F.aggregate(f"cells{n}", F.lit(0).cast("long"), lambda a, x: a + x["due"]) / 1024
        sources = sources.withColumn(f"walk{n}", _taken(F.col(f"cells{n}"), F.col("left") + due)).withColumn("left", F.col(f"walk{n}.left"))
    last = F.element_at("cells", -1)["class"]
    of = lambda name: F.element_at(F.array(*(F.col(f"{name}{n}") for n in names)), (last + 1).cast("int"))
    stop = F.get(F.filter(F.transform(of("cells"), lambda x: x["place"]), lambda x: x >= of("walk")["edge"]), F.lit(0))
    sources = sources.select("key", F.array(*(F.col(f"walk{n}.edge") for n in names)).alias("edges"), last.alias("last"), F.when(of("walk")["open"], F.lit(None)).otherwise(stop).alias("stop"), "left")
    sources = common.materialise(sources, "edges")
    inside = marked.join(sources, "key").where((F.col("class") == F.col("last")) & (F.col("bin") == F.col("stop")))
    parts = inside.groupBy("key", "left", "part").agg(F.sum("size").alias("held"))
    parts = parts.groupBy("key", "left").agg(F.sort_array(F.collect_list(F.struct(F.col("part").alias("place"), "held"))).alias("cells"))
    parts = parts.select("key", _taken(F.col("cells"), F.col("left"))["edge"].alias("upto"))
    return state.join(sources.drop("left"), "key", "left").join(parts, "key", "left")


def copies(rows: DataFrame, plan: DataFrame, most: float = MOST) -> DataFrame:
    """``rows`` (doc_id, key, size, copy and any others) with ``copies``; no shuffle of rows while the plan is small."""
    joined = rows.join(plan, "key").withColumns(_parts(most))
    on = (F.col("class") == F.col("last")) & (F.col("bin") == F.col("stop")) & (F.col("part") < F.col("upto"))
    more = (F.col("size") > 0) & (F.col("fraction") > 0) & ((F.col("bin") < F.element_at("edges", F.col("class") + 1)) | on)
    taken = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(more, F.lit(False)).cast("int")).otherwise(0)
    return joined.select(*rows.columns, "source_size", "target", taken.cast("long").alias("copies"))


def mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The plan of a corpus of ``measured`` rows."""
    histogram = common.materialise(rows.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "histogram")
    wanted = common.materialise(targets(histogram, weights, most), "targets")
    state = balance(histogram, wanted, most)
    return common.materialise(thresholds(rows, state, most), "plan")


def repeat(docs: DataFrame, most: float = MOST, **options) -> DataFrame:
    """``docs``, all columns, each row as often as the mix takes it; the texts are not shuffled while the plan is small."""
    rows = measured(docs, whole=True, **options)
    taken = copies(rows, mix(rows.drop("row"), most=most), most).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
