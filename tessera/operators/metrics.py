"""Competition metrics over keyed pairs of prediction and gold.

Rows are matched by key, never by position.  Metrics that are plain aggregates are builders ``fn(pred, gold) -> Column``
and share one pass; metrics that need ranks count distinct values first and rank only those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .scale import cut, positions, running_total

EPS = 2.220446049250313e-16  # distance from 1.0 to the next double; the clip of the log loss


def keyed(pred: DataFrame, gold: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Prediction and gold side by side as ``pred_c`` and ``gold_c``; only keys present in both."""
    p = pred.select(*key, *[F.col(c).alias(f"pred_{c}") for c in cols])
    g = gold.select(*key, *[F.col(c).alias(f"gold_{c}") for c in cols])
    return p.join(g, key)


def mse(p: Column, g: Column) -> Column:
    return F.avg((p - g) * (p - g))


def rmse(p: Column, g: Column) -> Column:
    return F.sqrt(mse(p, g))


def rmsle(p: Column, g: Column) -> Column:
    d = F.log1p(p) - F.log1p(g)
    return F.sqrt(F.avg(d * d))


def mae(p: Column, g: Column) -> Column:
    return F.avg(F.abs(p - g))


def smape(p: Column, g: Column, scale: float = 100.0, zero: str = "undefined") -> Column:
    """2|p-g| / (|p|+|g|); where both are 0 the term is NaN (``undefined``) or 0 (``zero``)."""
    den = F.abs(g) + F.abs(p)
    both = F.lit(float("nan")) if zero == "undefined" else F.lit(0.0)
    return scale * F.avg(F.when(den == 0, both).otherwise(2 * F.abs(p - g) / den))


def r2(p: Column, g: Column) -> Column:
    return 1 - F.avg((g - p) * (g - p)) / F.var_pop(g)


def accuracy(p: Column, g: Column) -> Column:
    return F.avg(F.coalesce((p == g).cast("double"), F.lit(0.0)))


def log_loss(p: Column, g: Column) -> Column:
    """Binary: p is the probability of gold 1."""
    q = T.clip(p, EPS, 1 - EPS)
    return -F.avg(F.when(g == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def log_loss_multi(p: list[Column], g: list[Column]) -> Column:
    """Gold is one-hot; predicted rows are scaled to sum 1."""
    total = reduce(lambda a, b: a + b, p)
    terms = [F.when(y == 1, F.ln(T.clip(x / total, EPS, 1 - EPS))).otherwise(0.0) for x, y in zip(p, g)]
    return -F.avg(reduce(lambda a, b: a + b, terms))


def hit_at(p: Column, g: Column, k: int = 3) -> Column:
    """Share of rows whose gold is among the first k white-space separated predictions."""
    return F.avg(F.array_contains(F.slice(T.words(p), 1, k), g).cast("double"))


def word_jaccard(p: Column, g: Column) -> Column:
    a, b = F.array_distinct(T.words(F.lower(p))), F.array_distinct(T.words(F.lower(g)))
    both = F.size(F.array_intersect(a, b))
    return F.avg(both / (F.size(a) + F.size(b) - both))


def pearson(p: Column, g: Column) -> Column:
    return F.corr(p.cast("double"), g.cast("double"))


METRICS = {"mse": mse, "rmse": rmse, "rmsle": rmsle, "mae": mae, "smape": smape, "r2": r2, "accuracy": accuracy,
           "log_loss": log_loss, "hit_at_3": hit_at, "word_jaccard": word_jaccard, "pearson": pearson}


def score(pairs: DataFrame, names: list[str], col: str, by: list[str] | None = None) -> DataFrame:
    """Several aggregate metrics of one column pair in one pass."""
    p, g = F.col(f"pred_{col}"), F.col(f"gold_{col}")
    return pairs.groupBy(*(by or [])).agg(*[METRICS[n](p, g).alias(n) for n in names])


def mean_over_columns(pairs: DataFrame, metric, cols: list[str], name: str) -> DataFrame:
    """Average of a metric over column pairs, still one aggregate."""
    parts = [metric(F.col(f"pred_{c}"), F.col(f"gold_{c}")).alias(f"_m{i}") for i, c in enumerate(cols)]
    row = pairs.agg(*parts)
    return row.select((reduce(lambda a, b: a + b, [F.col(f"_m{i}") for i in range(len(cols))]) / len(cols)).alias(name))


def median_absolute_error(pairs: DataFrame, col: str) -> DataFrame:
    """Exact median of the absolute errors: errors are counted per distinct value, then located by running totals."""
    err = pairs.select(F.abs(F.col(f"pred_{col}") - F.col(f"gold_{col}")).alias("e"))
    counts = err.groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(counts, [F.col("e")], {"upto": F.col("n")})
    size = counts.agg(F.sum("n").alias("_t"))
    low, high = F.floor((F.col("_t") + 1) / 2), F.floor((F.col("_t") + 2) / 2)
    return (placed.crossJoin(F.broadcast(size))  # one-row side
            .agg(((F.min(F.when(F.col("upto") >= low, F.col("e"))) + F.min(F.when(F.col("upto") >= high, F.col("e")))) / 2)
                 .alias("median_ae")))


def _long(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """(column, x, y): predicted and true values of all columns one below the other."""
    entry = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"pred_{c}").cast("double").alias("x"), F.col(f"gold_{c}").cast("double").alias("y"))
    return pairs.select(F.explode(F.array(*[entry(c) for c in cols])).alias("e")).select("e.*")


def _auc_by_column(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("column", F.col("x").alias("s")).agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") != 1).cast("long")).alias("neg"))
    run = running_total(per, [F.col("s")], {"below": F.col("neg")}, by=["column"])
    wins = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    return run.groupBy("column").agg((wins / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def roc_auc(pairs: DataFrame, col: str) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half.

    Positives and negatives are counted per distinct score; running totals over the distinct scores give the rest.
    """
    return _auc_by_column(_long(pairs, [col])).select("roc_auc")


def mean_roc_auc(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """One sort for all columns."""
    return _auc_by_column(_long(pairs, cols)).agg(F.avg("roc_auc").alias("roc_auc"))


def confusion(pairs: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    return pairs.groupBy(*(by or []), F.col(f"gold_{col}").alias("gold"), F.col(f"pred_{col}").alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def f1_scores(pairs: DataFrame, col: str, positive=1) -> DataFrame:
    """f1_binary (of ``positive``), f1_macro over the labels seen on either side, and f1_micro."""
    cells = confusion(pairs, col)
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    sides = (cells.select(F.col("gold").alias("label"), hit.alias("tp"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p"))
             .unionByName(cells.select(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p"))))
    per = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    f1 = 2 * F.col("tp") / (F.col("g") + F.col("p"))
    return per.agg(F.coalesce(F.max(F.when(F.col("label") == positive, f1)), F.lit(0.0)).alias("f1_binary"),
                   F.avg(f1).alias("f1_macro"), (F.sum("tp") / F.sum("g")).alias("f1_micro"))


def quadratic_weighted_kappa(pairs: DataFrame, col: str, classes: int) -> DataFrame:
    """1 - observed / expected squared disagreement.  The sums only need moments of both sides, so one pass does it."""
    p, g = F.col(f"pred_{col}").cast("double"), F.col(f"gold_{col}").cast("double")
    # sum over all cells of (i-j)^2 * row_i * col_j / N  =  E[g^2] - 2 E[g] E[p] + E[p^2], times N
    expected = F.avg(g * g) - 2 * F.avg(g) * F.avg(p) + F.avg(p * p)
    scale = float((classes - 1) ** 2)
    return pairs.agg((1 - (F.avg((g - p) * (g - p)) / scale) / (expected / scale)).alias("qwk"))


def spearman_by_column(rows: DataFrame) -> DataFrame:
    """(column, spearman) of a long table (column, x, y): Pearson correlation of tie-averaged ranks.

    Distinct value pairs are counted once.  Values of all columns and both sides are one table of counts, which is sorted once; its running totals are the ranks, and they
    come back to the value pairs by plain joins.
    """
    cells = cut(rows.groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("w")))
    side = lambda name: cells.select("column", F.lit(name).alias("side"), F.col(name).alias("v"), "w")
    values = side("x").unionByName(side("y")).groupBy("column", "side", "v").agg(F.sum("w").alias("n"))
    ranks = cut(running_total(values, [F.col("v")], {"upto": F.col("n")}, by=["column", "side"]).select("column", "side", "v", (F.col("upto") - (F.col("n") - 1) / 2).alias("r")))
    of = lambda name: ranks.filter(F.col("side") == name).select("column", F.col("v").alias(name), F.col("r").alias(f"r{name}"))
    both = cells.join(of("x"), ["column", "x"]).join(of("y"), ["column", "y"])
    w, x, y = F.col("w"), F.col("rx"), F.col("ry")
    n = F.sum(w)
    mid = (n + 1) / 2  # the mean of the ranks is known, so the moments can be centred in the same pass
    sxy, sxx, syy = F.sum(w * x * y), F.sum(w * x * x), F.sum(w * y * y)
    return both.groupBy("column").agg(((sxy - n * mid * mid) / F.sqrt((sxx - n * mid * mid) * (syy - n * mid * mid))).alias("spearman"))


def spearman(pairs: DataFrame, col: str) -> DataFrame:
    return spearman_by_column(_long(pairs, [col])).select("spearman")


def mean_spearman(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """One sort for all columns."""
    return spearman_by_column(_long(pairs, cols)).agg(F.avg("spearman").alias("spearman"))


def normalized_gini(pairs: DataFrame, col: str, key: list[str]) -> DataFrame:
    """Gini of the gold values ordered by falling prediction (ties in key order), over the Gini of the perfect order.

    An item at position i (from 0) enters n - i of the running sums, so positions are enough.  Equal gold values are interchangeable in the perfect order, so there counts of distinct values
    do instead of rows.
    """
    slim = pairs.select(*key, F.col(f"gold_{col}").cast("double").alias("g"), F.col(f"pred_{col}").alias("o"))
    rows = positions(slim, [F.desc("o"), *[F.col(k) for k in key]], "i").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("total"), F.sum(F.col("g") * F.col("i")).alias("weighted"))
    values = running_total(slim.groupBy("g").agg(F.count(F.lit(1)).alias("c")), [F.desc("g")], {"upto": F.col("c")})
    best = values.agg(F.sum(F.col("g") * F.col("c") * (F.col("upto") - (F.col("c") + 1) / 2)).alias("best"))
    gini = lambda weighted: ((F.col("n") * F.col("total") - F.col(weighted)) / F.col("total") - (F.col("n") + 1) / 2) / F.col("n")
    return rows.crossJoin(best).select((gini("weighted") / gini("best")).alias("normalized_gini"))  # one row each
