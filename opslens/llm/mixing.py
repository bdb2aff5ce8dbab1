"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each document gets a rate, the expected number of times it is taken. Of all rates that give every
source its target of words, those closest to one (in relative entropy, none above CAP) are
exp(tilt * size), cut at CAP, with one tilt per source: the dual of the problem is convex in the
tilts and Newton's method solves it, one distributed aggregate per step. Documents enter as counts
per (source, size), so no step touches more rows than there are different sizes.

Rates become whole copies: cumulated along the sizes, so that sums stay within one copy. What is left
over in words, such as the fraction of a very long document, is handed on along all sizes from large to
small, and what is then less than a document's size is evened out on the smallest sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

WEIGHTS = (5, 2, 1)
CAP = 3
STEPS = 60
TOLERANCE = 1e-9
# Documents of one (source, size) are ranked within this many slices, as a hot one may hold a third
# of all rows.
SLICES = 1024
# The smallest sizes of a source take up what is less than the size of a document after all sizes did.
EVENED_SIZES = 256

WORDS = r"[^\x20\x09-\x0D]+"
SOURCE = ["no_source", "name"]


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("bigint")


def exact_sum(values: Column) -> Column:
    """A sum that does not depend on the order of the rows, so that reruns agree."""
    return F.sum(values.cast("decimal(38,9)")).cast("double")


def source_targets(sources: DataFrame) -> DataFrame:
    """``sources`` (SOURCE, source_size, ...) with ``weight`` and ``target``.

    Ordered by code point, null last, sources weigh WEIGHTS in turn. Their position is counted per
    range of names and then added up over the ranges, so no task sees all of them.
    """
    spread = sources.repartitionByRange(*SOURCE).withColumn("part", F.spark_partition_id())
    spread = stored(spread, "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the shuffle.
    parts = spread.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*SOURCE))
    place = spread.join(F.broadcast(parts), "part").withColumn("place", F.col("before") + within - 1)
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    weight = F.element_at(weights, (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    weighed = stored(place.withColumn("weight", weight).drop("part", "before", "place"), "weighed", True)
    # The level at which a unit of weight is served. Sources that would pass CAP times their size
    # stop there, and the others share what remains; this only ever raises the level.
    level, stopped = 0.0, -1
    while True:
        over = F.col("weight") * level > CAP * F.col("source_size")
        total, fixed, free, count = weighed.agg(
            F.sum("source_size"),
            F.sum(F.when(over, CAP * F.col("source_size")).otherwise(0)),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))),
            F.count_if(over),
        ).first()
        if not free or count == stopped:
            break
        level, stopped = (total - fixed) / free, count
    target = F.least(CAP * F.col("source_size").cast("double"), F.col("weight") * F.lit(float(level)))
    return weighed.withColumn("target", target)


def tilts(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with ``tilt``, so that the sum of n * size * rate over its cells is the target.

    Newton's method on the dual, held between bounds that close in with every step: a step that
    leaves them is replaced by their middle.
    """
    mean = F.col("source_size") / F.col("n_docs")
    ratio = F.col("target") / F.col("source_size")
    # At the bounds even the smallest document has the ratio, or the cap.
    reach = mean / F.col("least_size")
    state = sources.where("source_size > 0").select(
        *SOURCE,
        "target",
        mean.alias("mean"),
        F.lit(0.0).alias("tilt"),
        F.when(ratio < 1, F.ln(ratio) * reach).otherwise(0.0).alias("low"),
        F.when(ratio < 1, 0.0).otherwise(F.ln(F.lit(float(CAP))) * reach).alias("high"),
        F.lit(1.0).alias("error"),
    )
    state = stored(state, "tilts", True)
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.col("tilt") * x)
        words = F.col("n") * F.col("size") * F.least(raw, F.lit(float(CAP)))
        steps = cells.where("size > 0").join(state, SOURCE).groupBy(*state.columns).agg(
            exact_sum(words).alias("got"),
            exact_sum(F.when(raw < CAP, words * x).otherwise(0.0)).alias("slope"),
        )
        miss = F.col("got") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - miss / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (newton > low) & (newton < high)
        error = F.abs(miss) / F.greatest("target", F.lit(1.0))
        done = (error < TOLERANCE) | (high - low < TOLERANCE * F.abs(high))
        moved = F.when(done, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2)
        state = stored(
            steps.select(
                *SOURCE, "target", "mean", moved.alias("tilt"), low.alias("low"), high.alias("high"),
                F.when(done, 0.0).otherwise(error).alias("error"),
            ),
            "tilts",
            True,
        )
        if (state.agg(F.max("error")).first()[0] or 0.0) == 0.0:
            break
    return sources.join(state.select(*SOURCE, "mean", "tilt"), SOURCE, "left")


def handed_on(rounded: DataFrame, falling: Window) -> DataFrame:
    """``rounded`` with what is left of the target taken up by the sizes that it covers, the largest
    first, each as far as it goes between least and most copies."""
    words = F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy(*SOURCE))
    left = F.col("target") - words
    room = F.when(F.col("left") > 0, F.col("most") - F.col("copies")).otherwise(F.col("copies") - F.col("least"))
    room = F.when(F.col("size") <= F.abs("left"), room * F.col("size")).otherwise(0)
    before = F.sum("room").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    share = F.greatest(F.abs("left") - F.coalesce(before, F.lit(0)), F.lit(0.0))
    moved = F.floor(F.least(F.col("room"), share) / F.col("size")).cast("bigint")
    given = rounded.withColumn("left", left).withColumn("room", room).withColumn("moved", moved)
    now = F.col("copies") + F.when(F.col("left") > 0, F.col("moved")).otherwise(-F.col("moved"))
    return given.withColumn("copies", now).drop("left", "room", "moved")


def copies(cells: DataFrame, tilted: DataFrame) -> DataFrame:
    """Per cell: rate, and the copies taken of all its documents together."""
    rate = F.least(F.exp(F.col("tilt") * F.col("size") / F.col("mean")), F.lit(float(CAP)))
    rated = cells.join(tilted, SOURCE).withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
    # Whole parts as they are; fractions cumulated from the largest size down, within one copy.
    falling = Window.partitionBy(*SOURCE).orderBy(F.col("size").desc())
    parts = F.col("n") * (F.col("rate") - F.floor("rate"))
    upto = F.floor(F.sum(parts).over(falling.rowsBetween(Window.unboundedPreceding, 0)) + 0.5)
    before = F.floor(F.coalesce(F.sum(parts).over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + 0.5)
    whole = (F.col("n") * F.floor("rate") + upto - before).cast("bigint")
    rising = F.row_number().over(Window.partitionBy(*SOURCE).orderBy("size"))
    rounded = rated.where("size > 0").withColumns({"copies": whole, "rank": rising})
    # No document's copies are further from its rate than rounding takes them.
    least = (F.col("n") * F.floor("rate")).cast("bigint").alias("least")
    most = (F.col("n") * F.ceil("rate")).cast("bigint").alias("most")
    rounded = rounded.select(*SOURCE, "size", "n", "target", "rate", "copies", "rank", least, most)
    rounded = stored(handed_on(rounded, falling), "copies", True)
    left = rounded.groupBy(*SOURCE).agg(
        (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"),
        # At most EVENED_SIZES cells of a source.
        F.sort_array(
            F.collect_list(F.when(F.col("rank") <= EVENED_SIZES, F.struct("size", "copies", "least", "most"))),
            asc=False,
        ).alias("small"),
    )

    def even(done: Column, cell: Column) -> Column:
        wished = cell["copies"] + F.round(done["left"] / cell["size"]).cast("bigint")
        now = F.greatest(cell["least"], F.least(wished, cell["most"]))
        rest = done["left"] - cell["size"] * (now - cell["copies"])
        cells = F.array_append(done["cells"], F.struct(cell["size"].alias("size"), now.alias("even")))
        return F.struct(rest.alias("left"), cells.alias("cells"))

    start = F.struct(
        F.col("left").cast("double").alias("left"),
        F.array().cast("array<struct<size:bigint,even:bigint>>").alias("cells"),
    )
    evened = left.select(*SOURCE, F.explode(F.aggregate("small", start, even)["cells"]).alias("c"))
    evened = evened.select(*SOURCE, "c.size", "c.even")
    return rounded.join(evened, [*SOURCE, "size"], "left").select(
        *SOURCE, "size", "n", "rate", F.coalesce("even", "copies").alias("copies")
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken, rate, copies.

    ``taken`` is copies * size. Which of equally large documents of a source get one copy more goes by
    the hash of their id, so reruns agree. Null texts, like all without words, have size 0 and are
    never taken; a null source is a source of its own, a null id an id like others. Other columns of
    ``docs`` are not read.
    """
    slot = F.pmod(F.xxhash64(F.col("doc")), F.lit(SLICES)).cast("int")
    rows = docs.select(
        F.col(id_col).alias("doc"),
        F.col(source_col).isNull().alias(SOURCE[0]),
        F.coalesce(source_col, F.lit("")).alias(SOURCE[1]),
        word_count(text_col).alias("size"),
    )
    rows = stored(rows.withColumn("slot", slot), "sizes")
    slots = stored(rows.groupBy(*SOURCE, "size", "slot").agg(F.count("*").alias("n")), "slots", True)
    cells = stored(slots.groupBy(*SOURCE, "size").agg(F.sum("n").alias("n")), "cells", True)
    sources = cells.groupBy(*SOURCE).agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("n_docs"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"),
    )
    targets = stored(source_targets(sources), "targets", True)
    taken = copies(cells, stored(tilts(cells, targets), "tilted", True)).withColumnRenamed("n", "of")
    # Of a cell's copies every document gets the whole part; the rest goes to slots in proportion.
    dealt = slots.join(taken, [*SOURCE, "size"])
    order = Window.partitionBy(*SOURCE, "size").orderBy("slot")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    extra = F.col("copies") % F.col("of")
    share = F.expr("(upto * extra) div of - ((upto - n) * extra) div of")
    dealt = dealt.withColumns({"upto": upto, "extra": extra}).select(
        *SOURCE, "size", "slot", "rate", F.expr("copies div of").alias("each"), share.alias("more")
    )
    rank = F.row_number().over(
        Window.partitionBy(*SOURCE, "size", "slot").orderBy(F.xxhash64(F.lit("rank"), F.col("doc")), "doc")
    )
    ranked = rows.join(dealt, [*SOURCE, "size", "slot"], "left").withColumn("rank", rank)
    count = F.coalesce(F.col("each") + F.when(F.col("rank") <= F.col("more"), 1).otherwise(0), F.lit(0))
    known = targets.select(*SOURCE, "source_size", "target")
    return ranked.withColumn("copies", count.cast("bigint")).join(known, SOURCE).select(
        F.col("doc").alias(id_col),
        F.when(~F.col(SOURCE[0]), F.col(SOURCE[1])).alias(source_col),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        F.coalesce("rate", F.lit(0.0)).alias("rate"),
        "copies",
    )
