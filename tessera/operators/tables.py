"""Recipes for questions asked of tables: totals, cleaning, comparisons, reconciliation, trends and simple models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scale import cut, running_total, top_k


def totals(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count(value).alias("count"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def join_totals(facts: DataFrame, dims: DataFrame, key: str, by: str, value: str) -> DataFrame:
    """Totals by a dimension.  Facts are added up per key first, so the join moves one row per key."""
    per = facts.groupBy(key).agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    return per.join(dims.select(key, by), key).groupBy(by).agg(F.sum("_v").alias("total"), F.sum("_n").alias("count"))


def clean_rows(df: DataFrame, value: str, limit: float) -> DataFrame:
    """Rows whose value is there and not above the limit."""
    return df.filter(F.col(value).isNotNull() & (F.col(value) <= limit))


def ordered_totals(df: DataFrame, category: str, order: list[str], value: str) -> DataFrame:
    """Total and share per category with the declared position of the category; those not declared follow, by name, without a position."""
    per = df.groupBy(category).agg(F.sum(value).alias("total"))
    everything = df.agg(F.sum(value).alias("_all"))
    place = F.nullif(F.array_position(F.array(*[F.lit(c) for c in order]), F.col(category)).cast("int"), F.lit(0))
    return (per.crossJoin(F.broadcast(everything)).withColumn("position", place).withColumn("share", F.col("total") / F.col("_all")).drop("_all")  # one-row side
            .orderBy(F.col("position").asc_nulls_last(), category))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, sample deviation, minimum and maximum per column: one pass, one row per column."""
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[f(c).cast("double").alias(f"{c}|{n}") for c in cols for n, f in stats.items()])
    each = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}|{n}").alias(n) for n in stats]) for c in cols])
    return row.select(F.explode(each).alias("r")).select("r.*")


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Counts of ``row`` by the listed values of ``col``."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(str(v)) for v in values])


def many_partners(df: DataFrame, key: str, partner: str) -> DataFrame:
    """Keys with more than one distinct partner.  Pairs are made distinct map-side before they are counted."""
    return (df.select(key, partner).distinct().groupBy(key).agg(F.count(partner).alias("partners")).filter("partners > 1"))


def modelling_table(base: DataFrame, parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """Left joins of lookup tables, each by its key."""
    return reduce(lambda d, p: d.join(p[0], p[1], "left"), parts, base)


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """Chi-square statistic, degrees of freedom and size of the contingency table; works on the counted cells."""
    cells = df.groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    rs, cs = cells.groupBy("r").agg(F.sum("n").alias("rn")), cells.groupBy("c").agg(F.sum("n").alias("cn"))
    size = cells.agg(F.sum("n").alias("total"), F.count_distinct("r").alias("nr"), F.count_distinct("c").alias("nc"))
    # sum (o-e)^2/e over all cells = N * (sum o^2 / (row * col) - 1); empty cells add nothing
    return (cells.join(rs, "r").join(cs, "c").agg(F.sum(F.col("n") * F.col("n") / (F.col("rn") * F.col("cn"))).alias("_q"))
            .crossJoin(size).select((F.col("total") * (F.col("_q") - 1)).alias("chi2"),  # one row each
                                    ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("dof"), F.col("total").alias("n")))


def stratified_rates(df: DataFrame, stratum: str, group: str, event: Column) -> DataFrame:
    """Event rates per stratum and group, and pooled over the strata."""
    return (df.select(F.col(stratum).cast("string").alias("stratum"), F.col(group).alias("group"), event.cast("double").alias("_e"))
            .groupingSets([[F.col("stratum"), F.col("group")], [F.col("group")]], "stratum", "group")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("rate"), F.grouping("stratum").alias("_g"))
            .withColumn("stratum", F.when(F.col("_g") == 1, "pooled").otherwise(F.col("stratum"))).drop("_g"))


def exact_quantiles(df: DataFrame, col: str, shares: list[float]) -> DataFrame:
    """One row with the array ``_q`` of exact quantiles: of each share the smallest value that at least that part of the rows does not exceed.

    Values are counted first, so copies are combined map-side; ranks come from running totals over the distinct values.
    """
    counts = cut(df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n")))
    placed = running_total(counts, [F.col("v")], {"upto": F.col("n")})
    total = counts.agg(F.sum("n").alias("_all"))
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.col("_all") * q))
    return placed.crossJoin(F.broadcast(total)).agg(F.array(*[F.min(F.when(F.col("upto") >= rank(q), F.col("v"))) for q in shares]).alias("_q"))  # one-row side


def winsorise(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Values clipped to two exact quantiles; null stays null."""
    return _clipped(df, col, exact_quantiles(df, col, [low, high]))


def winsorise_approximately(df: DataFrame, col: str, low: float, high: float, accuracy: int = 100_000) -> DataFrame:
    """Values clipped to two quantiles of a mergeable sketch, in one pass; ranks are off by 1 / ``accuracy`` of the rows at most."""
    return _clipped(df, col, df.agg(F.percentile_approx(col, [low, high], accuracy).alias("_q")))


def _clipped(df: DataFrame, col: str, q: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(q)).withColumn(col, F.when(F.col(col).isNotNull(), F.greatest(F.least(F.col(col), F.col("_q")[1]), F.col("_q")[0]))).drop("_q")  # one-row side


def logistic_regression(df: DataFrame, label: str, covariates: list[str], max_iter: int = 50) -> DataFrame:
    """Coefficients of a logistic regression: one row per covariate and the intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    rows = VectorAssembler(inputCols=covariates, outputCol="features", handleInvalid="skip").transform(
        df.select(F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in covariates]))
    model = LogisticRegression(maxIter=max_iter, tol=1e-9).fit(rows)
    return df.sparkSession.createDataFrame([("intercept", float(model.intercept)), *zip(covariates, map(float, model.coefficients))],
                                           "term string, coefficient double")


def group_traits(df: DataFrame, group: str, level: str, high, low, traits: list[str]) -> DataFrame:
    """Per group: size, missing values and mean of each trait, and the difference of its means between two levels."""
    out = [F.count(F.lit(1)).alias("n")]
    for t in traits:
        gap = F.avg(F.when(F.col(level) == high, F.col(t))) - F.avg(F.when(F.col(level) == low, F.col(t)))
        out += [F.count_if(F.col(t).isNull()).alias(f"{t}_missing"), F.avg(t).alias(f"{t}_mean"), gap.alias(f"{t}_gap")]
    return df.groupBy(group).agg(*out)


def grouped_correlation(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Correlation overall and inside each group."""
    return (df.groupingSets([[F.col(group)], []], group).agg(F.corr(x, y).alias("corr"), F.count(F.lit(1)).alias("n"), F.grouping(group).alias("_g"))
            .withColumn(group, F.when(F.col("_g") == 1, "overall").otherwise(F.col(group).cast("string"))).drop("_g"))


def change_between(df: DataFrame, entity: str, period: str, value: str, first, last) -> DataFrame:
    """Value in two periods, the change, whether it is back at the first level, and the rank by change.

    One row per entity remains after the aggregate; ranks count the entities with a larger change.
    """
    from .scale import running_total
    v = lambda p: F.sum(F.when(F.col(period) == p, F.col(value)))
    per = df.filter(F.col(period).isin(first, last)).groupBy(entity).agg(v(first).alias("before"), v(last).alias("after"))
    per = per.filter("before IS NOT NULL AND after IS NOT NULL").withColumn("change", F.col("after") - F.col("before"))
    per = per.withColumn("recovered", F.col("after") >= F.col("before"))
    levels = running_total(per.groupBy("change").agg(F.count(F.lit(1)).alias("_n")), [F.desc("change")], {"_upto": F.col("_n")})
    ranks = levels.select("change", (F.col("_upto") - F.col("_n") + 1).alias("rank"))
    return per.join(ranks, "change").select(entity, "before", "after", "change", "recovered", "rank")


def reconcile(fine: DataFrame, coarse: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Fine rows rolled up against a coarse table: keys missing on one side and measures that differ."""
    up = fine.groupBy(*keys).agg(*[F.sum(m).alias(f"fine_{m}") for m in measures], F.lit(True).alias("_f"))
    down = coarse.select(*keys, *[F.col(m).alias(f"coarse_{m}") for m in measures], F.lit(True).alias("_c"))
    both = up.join(down, keys, "full_outer")
    diff = F.array_compact(F.array(*[F.when(~F.round(f"fine_{m}", 6).eqNullSafe(F.round(f"coarse_{m}", 6)), F.lit(m)) for m in measures]))
    problem = F.when(F.col("_f").isNull(), "missing_in_fine").when(F.col("_c").isNull(), "missing_in_coarse").when(F.size(diff) > 0, F.concat(F.lit("differs: "), F.array_join(diff, ",")))
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").drop("_f", "_c")


def yearly_growth(df: DataFrame, group: str, year: Column, value: str) -> DataFrame:
    """Total per group and year with the growth over the year before.  The window sees one row per group and year."""
    per = df.groupBy(group, year.alias("year")).agg(F.sum(value).alias("total"))
    prev = F.lag("total").over(W.partitionBy(group).orderBy("year"))
    return per.withColumn("growth", F.col("total") / prev - 1)


def peak_slots(df: DataFrame, day_type: Column, slot: Column, value: str) -> DataFrame:
    """The busiest slot of each day type, with its mean and support."""
    per = df.groupBy(day_type.alias("day_type"), slot.alias("slot")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("support"))
    return top_k(per, ["day_type"], [F.desc("mean"), F.col("slot")], 1).drop("rank")


def condition_totals(df: DataFrame, conditions: list[Column], names: list[str], value: str) -> DataFrame:
    return df.groupBy(*[c.alias(n) for c, n in zip(conditions, names)]).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("support"))


def filtered_ranking(df: DataFrame, where: Column, order: list, k: int, cols: list[str]) -> DataFrame:
    """The k best rows that meet all conditions."""
    return df.filter(where).orderBy(*order).limit(k).select(*cols)
