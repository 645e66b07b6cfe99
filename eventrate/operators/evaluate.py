"""How well scores and classes agree with the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventrate.functions import tails
from eventrate.operators.rank import running_sums
from eventrate.runtime import LIMITS, Limits, materialise


def classify(
    df: DataFrame, score: str, cutoff: float | None = None, event: str | None = None, name: str = "predicted"
) -> DataFrame:
    """1 where the score reaches the cutoff, by default the share of events in the data."""
    if cutoff is None:
        cutoff = df.agg(F.avg(F.col(event).cast("int")).alias("share")).first()["share"]
    return df.withColumn(name, (F.col(score) >= F.lit(cutoff)).cast("int"))


def confusion(df: DataFrame, predicted: str, event: str) -> DataFrame:
    """The four cells of the confusion matrix, positive class 1."""
    p, e = F.col(predicted), F.col(event)
    return df.agg(
        F.count_if((p == 1) & (e == 1)).alias("tp"), F.count_if((p == 0) & (e == 1)).alias("fn"),
        F.count_if((p == 1) & (e == 0)).alias("fp"), F.count_if((p == 0) & (e == 0)).alias("tn"),
    )


def _share(a, b):
    return F.when(b != 0, a / b)


def confusion_stats(cells: DataFrame) -> DataFrame:
    """Rates of a confusion matrix as arithmetic on its four cells."""
    tp, fn, fp, tn = (F.col(c).cast("double") for c in ("tp", "fn", "fp", "tn"))
    n, ones, zeros = tp + fn + fp + tn, tp + fn, fp + tn
    chance = _share((tp + fp) * ones + (fn + tn) * zeros, n * n)
    accuracy = _share(tp + tn, n)
    return cells.select(
        accuracy.alias("accuracy"),
        _share(F.greatest(ones, zeros), n).alias("no_information_rate"),
        _share(accuracy - chance, 1 - chance).alias("kappa"),
        _share(tp, ones).alias("sensitivity"),
        _share(tn, zeros).alias("specificity"),
        _share(tp, tp + fp).alias("ppv"),
        _share(tn, fn + tn).alias("npv"),
        _share(ones, n).alias("prevalence"),
        _share(tp, n).alias("detection_rate"),
        _share(tp + fp, n).alias("detection_prevalence"),
        ((_share(tp, ones) + _share(tn, zeros)) / 2).alias("balanced_accuracy"),
    )


def confusion_tests(cells: DataFrame, level: float = 0.95) -> DataFrame:
    """Exact interval of the accuracy, its test against the no-information rate, and McNemar's test.

    Works on the four counts alone.
    """
    row = cells.first()
    tp, fn, fp, tn = (int(row[c]) for c in ("tp", "fn", "fp", "tn"))
    n, right = tp + fn + fp + tn, tp + tn
    low, high = tails.binomial_interval(right, n, level) if n else (None, None)
    base = max(tp + fn, fp + tn) / n if n else None
    chi = (abs(fp - fn) - 1) ** 2 / (fp + fn) if fp + fn else None
    out = (
        low, high, tails.binomial_upper(right, n, base) if n else None,
        chi, tails.chi_square_upper(chi, 1) if chi is not None else None,
    )
    return cells.sparkSession.createDataFrame(
        [out], "accuracy_low double, accuracy_high double, accuracy_p double, mcnemar double, mcnemar_p double"
    )


def error_rate(df: DataFrame, predicted: str, event: str) -> DataFrame:
    """Share of rows whose class differs from the outcome."""
    return df.agg(F.avg((F.col(predicted) != F.col(event)).cast("int")).alias("error_rate"))


def kappa(df: DataFrame, first: str, second: str) -> DataFrame:
    """Cohen's unweighted kappa of two raters with its z value under chance agreement."""
    pairs = (
        df.dropna(subset=[first, second])
        .groupBy(F.col(first).cast("string").alias("a"), F.col(second).cast("string").alias("b"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    zero = F.lit(0.0)
    agree = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(zero)
    margins = (
        pairs.select(
            F.inline(
                F.array(
                    F.struct(F.col("a").alias("level"), F.col("n").alias("r"), zero.alias("c"), agree.alias("same")),
                    F.struct(F.col("b").alias("level"), zero.alias("r"), F.col("n").alias("c"), zero.alias("same")),
                )
            )
        )
        .groupBy("level").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum("same").alias("same"))
    )
    r, c, n = F.col("r"), F.col("c"), F.col("n")
    sums = margins.agg(
        F.sum("r").alias("n"), F.sum("same").alias("same"), F.sum(r * c).alias("rc"),
        F.sum(r * c * (r + c)).alias("rcrc"),
    )
    po, pe = F.col("same") / n, F.col("rc") / (n * n)
    spread = F.sqrt(pe + pe * pe - F.col("rcrc") / (n * n * n)) / ((1 - pe) * F.sqrt(n))
    value = (po - pe) / (1 - pe)
    return sums.where(n > 0).select(
        n.cast("bigint").alias("subjects"), F.when(pe < 1, value).alias("kappa"),
        F.when((pe < 1) & (spread > 0), value / spread).alias("z"),
    )


def kappa_test(df: DataFrame, first: str, second: str) -> DataFrame:
    """Kappa with the two-sided p value of its z."""
    row = kappa(df, first, second).first()
    p = None if row is None or row["z"] is None else tails.normal_two_sided(row["z"])
    values = (None, None, None, None) if row is None else (row["subjects"], row["kappa"], row["z"], p)
    return df.sparkSession.createDataFrame([values], "subjects bigint, kappa double, z double, p_value double")


# --- curves and pairs ------------------------------------------------------------------


def score_counts(df: DataFrame, score: str, event: str, limits: Limits = LIMITS) -> DataFrame:
    """Events and non-events per distinct score, with the counts of all lower scores.

    Rows collapse to distinct scores before the shuffle, so a score shared by many rows is
    harmless; the running counts are taken over range-partitioned scores.
    """
    e = F.col(event).cast("int")
    table = (
        df.where(F.col(score).isNotNull() & e.isNotNull())
        .groupBy(F.col(score).alias("score"))
        .agg(F.sum(e).cast("bigint").alias("ones"), F.sum(1 - e).cast("bigint").alias("zeros"))
    )
    return running_sums(
        materialise(table, "scores"), ["score"], {"ones_below": "ones", "zeros_below": "zeros"}, limits
    )


def _totals(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.coalesce(F.sum("ones"), F.lit(0)).cast("bigint").alias("all_ones"),
        F.coalesce(F.sum("zeros"), F.lit(0)).cast("bigint").alias("all_zeros"),
    )


def roc_curve(df: DataFrame, score: str, event: str, limits: Limits = LIMITS) -> DataFrame:
    """True and false positive rate when every row with at least this score is called positive.

    A row without score stands for the start of the curve, where nothing is called positive.
    """
    counts = score_counts(df, score, event, limits)
    total = _totals(counts).first()
    ones, zeros = F.lit(total["all_ones"]), F.lit(total["all_zeros"])
    points = counts.select(
        "score", (ones - F.col("ones_below")).cast("bigint").alias("tp"),
        (zeros - F.col("zeros_below")).cast("bigint").alias("fp"),
    )
    origin = df.sparkSession.createDataFrame([(0, 0)], "tp bigint, fp bigint")
    return points.unionByName(origin, allowMissingColumns=True).select(
        "score", "tp", "fp", _share(F.col("tp"), ones).alias("tpr"), _share(F.col("fp"), zeros).alias("fpr")
    )


def concordance(df: DataFrame, score: str, event: str, limits: Limits = LIMITS) -> DataFrame:
    """Event/non-event pairs ordered rightly, wrongly or tied by the score, without forming pairs."""
    counts = score_counts(df, score, event, limits)
    big = {c: F.col(c).cast("decimal(19,0)") for c in ("ones", "zeros", "zeros_below")}
    sums = counts.agg(
        F.coalesce(F.sum(big["ones"] * big["zeros_below"]), F.lit(0)).cast("decimal(38,0)").alias("concordant"),
        F.coalesce(F.sum(big["ones"] * big["zeros"]), F.lit(0)).cast("decimal(38,0)").alias("ties"),
        F.coalesce(F.sum(big["ones"]), F.lit(0)).cast("decimal(19,0)").alias("all_ones"),
        F.coalesce(F.sum(big["zeros"]), F.lit(0)).cast("decimal(19,0)").alias("all_zeros"),
    ).withColumn("pairs", (F.col("all_ones") * F.col("all_zeros")).cast("decimal(38,0)"))
    rest = (F.col("pairs") - F.col("concordant") - F.col("ties")).cast("decimal(38,0)")
    out = sums.select("pairs", "concordant", rest.alias("discordant"), "ties")
    n = F.col("pairs").cast("double")
    return out.withColumns(
        {f"{new}_ratio": _share(F.col(c).cast("double"), n)
         for new, c in (("concordance", "concordant"), ("discordance", "discordant"), ("tie", "ties"))}
    )


def auc(df: DataFrame, score: str, event: str, limits: Limits = LIMITS) -> DataFrame:
    """Area under the ROC curve: the share of rightly ordered pairs, ties counting half."""
    pairs = concordance(df, score, event, limits)
    half = F.col("concordant").cast("double") + F.col("ties").cast("double") / 2
    return pairs.select(_share(half, F.col("pairs").cast("double")).alias("auc"))
