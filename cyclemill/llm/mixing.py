"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

A document's rate, how often it is taken, is the nearest to once each (in relative entropy) whose token sums meet the
sources' targets and that exceeds MOST nowhere: min(MOST, exp(lambda * size / mean size)) with one dual variable for each
source. The dual is convex; Newton steps, kept in a bracket, solve it for all sources at once. Each step is one aggregate
over the table of (source, size) counts, as the rate depends on nothing else.

Rates become copies by cumulative rounding over a source's sizes: its total is then off by less than its largest
document. FIXES rounds of adding or removing the one copy that fits best bring it closer. Which of a size's documents get
the copy more is settled by a rank; a size that a third of all documents share is ranked in chunks.

Null and empty texts have size 0: they are taken once (if their source's target is above 0) and add nothing. A null source
is a source, the last. A source without words has target 0. An empty table gives an empty result. Repeated rows are
documents each. Columns of the names given here are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cyclemill.llm.shared import MAX_IDS, WORD, apart, keyed, ranked, stored, table

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
STEPS = 60
TOLERANCE = 1e-10
FIXES = 4


def sized(docs: DataFrame) -> DataFrame:
    """docs with size (words) and source_key, which sorts by code point with null last."""
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0))).withColumn("source_key", key)


def targets(cells: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source_key, source_size, target) of cells (source_key, size, n): one row per source.

    Weights share the sum of all sizes. With sources sorted by most * size / weight, those from the start on are full for
    which the level that the rest would get is not lower; the first that isn't full sets the level of all after it.
    """
    sizes = cells.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    number = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(most))
    one = Window.partitionBy()
    order = Window.orderBy(full / F.col("weight"), "source_key")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(one) - F.coalesce(F.sum(full).over(earlier), F.lit(0.0))) / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    own = sizes.withColumn("weight", weight).withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < full)
    own = own.withColumn("level", F.min(F.when(F.col("open"), F.struct((full / F.col("weight")).alias("at"), "source_key", "level"))).over(one)["level"])
    return own.select("source_key", "source_size", F.coalesce(F.least(full, F.col("level") * F.col("weight")), full).alias("target"))


def rates(cells: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """cells with rate; the largest relative miss of a target is TOLERANCE, or what STEPS steps reach."""
    mean = cells.groupBy("source_key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    goal = sources.join(mean, "source_key").withColumn("full", F.col("target") >= F.col("source_size") * most * (1 - 1e-12))
    state = stored(goal.select("source_key", "target", "mean", "full", F.lit(0.0).alias("dual"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")))
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("dual") * x, F.lit(700.0)))
        mass = F.col("n") * F.col("size")
        at = (
            cells.join(state.where("not full"), "source_key")
            .groupBy("source_key")
            .agg(F.sum(mass * F.least(rate, F.lit(float(most)))).alias("sum"), F.sum(F.when(rate < most, mass * x * rate).otherwise(0.0)).alias("slope"))
        )
        miss = F.col("sum") - F.col("target")
        near = state.join(at, "source_key", "left").withColumn("miss", F.when(F.abs(miss) > TOLERANCE * F.col("target"), miss))
        near = near.withColumn("low", F.when(F.col("miss") < 0, F.col("dual")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("miss") > 0, F.col("dual")).otherwise(F.col("high")))
        step = F.col("dual") - F.try_divide(F.col("miss"), F.col("slope"))
        wide = F.when(F.col("miss") < 0, F.coalesce((F.col("low") + F.col("high")) / 2, F.greatest(F.col("dual") * 2, F.lit(1.0)))).otherwise(F.coalesce((F.col("low") + F.col("high")) / 2, F.least(F.col("dual") * 2, F.lit(-1.0))))
        inside = step.isNotNull() & ~(step <= F.coalesce("low", F.lit(float("-inf")))) & ~(step >= F.coalesce("high", F.lit(float("inf")))) & (F.abs(step - F.col("dual")) <= 64)
        state = stored(near.select("source_key", "target", "mean", "full", F.when(F.col("miss").isNull(), F.col("dual")).when(inside, step).otherwise(wide).alias("dual"), "low", "high", F.col("miss").isNotNull().alias("moving")))
        if not state.where("moving").limit(1).count():
            break
        state = state.drop("moving")
    found = F.when(F.col("target") <= 0, 0.0).when(F.col("full"), float(most)).otherwise(F.least(F.exp(F.least(F.col("dual") * F.col("size") / F.col("mean"), F.lit(700.0))), F.lit(float(most))))
    return cells.join(state.select("source_key", "target", "mean", "full", "dual"), "source_key").select("source_key", "size", "n", "target", F.round(found, 9).alias("rate"))


def copies(cells: DataFrame, most: int = MOST) -> DataFrame:
    """cells (source_key, size, n, target, rate) with takes: copies of all the cell's documents together."""
    upto = Window.partitionBy("source_key").orderBy("size")
    # whole billionths add up to the same sum in any order
    part = F.round((F.col("rate") - F.floor("rate")) * 1_000_000_000).cast("decimal(38,0)") * F.col("n")
    half = F.lit(500_000_000).cast("decimal(38,0)")
    whole = F.floor((F.sum(part).over(upto) + half) / F.lit(1_000_000_000)).cast("long")
    out = cells.withColumn("whole", whole)
    out = out.withColumn("takes", F.floor("rate").cast("long") * F.col("n") + F.col("whole") - F.coalesce(F.lag("whole").over(upto), F.lit(0)))
    out = stored(out.drop("whole"))
    for _ in range(FIXES):
        off = out.groupBy("source_key").agg(F.round(F.first("target") - F.sum(F.col("takes") * F.col("size"))).cast("long").alias("off"))
        fits = F.when(F.col("off") > 0, F.col("takes") < most * F.col("n")).otherwise(F.col("takes") > 0) & (F.col("size") > 0) & (F.abs(F.abs("off") - F.col("size")) < F.abs("off"))
        pick = out.join(off, "source_key").where(fits).groupBy("source_key").agg(F.min(F.struct(F.abs(F.abs("off") - F.col("size")).alias("left"), "size")).alias("p"), F.first(F.signum("off").cast("long")).alias("sign"))
        pick = pick.select("source_key", F.col("p.size").alias("size"), "sign")
        out = stored(out.join(pick, ["source_key", "size"], "left").withColumn("takes", F.col("takes") + F.coalesce("sign", F.lit(0))).drop("sign"))
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, key: str = "doc_id") -> DataFrame:
    """(key, source_key, size, source_size, target, rate, copies) of each row of docs (key, text, source)."""
    rows = stored(sized(docs.select(key, "text", "source")).drop("text", "source"))
    cells = stored(rows.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = stored(targets(cells, weights, most))
    taken = copies(rates(cells, sources, most), most)
    largest = cells.agg(F.max("n")).first()[0] or 1
    each = ranked(rows, ["source_key", "size"], [key], largest).join(taken, ["source_key", "size"]).join(sources.select("source_key", "source_size"), "source_key")
    number = F.floor(F.col("takes") / F.col("n")) + (F.col("rank_") < F.col("takes") % F.col("n")).cast("long")
    return each.select(key, "source_key", "size", "source_size", "target", "rate", number.cast("long").alias("copies"))


def repeated(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs, each row as often as the mix takes it. Rows are told apart by a key of their own. Texts are shuffled only if the mix
    takes more than MAX_IDS rows."""
    columns, docs = docs.columns, apart(docs, "text", "source")
    own = docs.columns
    docs = keyed(docs)
    number = stored(mix(docs, weights, most, "row_key_").where("copies > 0").select("row_key_", F.col("copies").cast("byte").alias("copies_")))
    again = docs.join(F.broadcast(number) if number.count() <= MAX_IDS else number, "row_key_").select(*own, "copies_")
    return again.withColumn("copies_", F.explode(F.sequence(F.lit(1), F.col("copies_")))).drop("copies_").toDF(*columns)


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
