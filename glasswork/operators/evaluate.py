"""Evaluation: curves, tables and metrics of scored rows as tidy DataFrames.

Scored rows first collapse to counts per distinct score (map-side combined);
every curve then runs on those counts through distributed prefix sums. ``by``
names grouping columns, so all folds or classes share one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswork.operators.binning import SKETCH_ACCURACY
from glasswork.operators.ranks import count_below, discrete_quantiles, prefix_sums, quantile_edges, quantiles
from glasswork.sources.checkpoint import cut_lineage

THRESHOLDS = 21


def _ratio(a, b) -> Column:
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def _dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# --- classification at a threshold -----------------------------------------

def confusion_matrix(df: DataFrame, y: str = "y", yhat: str = "prediction", by=()) -> DataFrame:
    """Counts by actual and predicted label."""
    return df.groupBy(*by, F.col(y).alias("actual"), F.col(yhat).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_by_threshold(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    """Counts and shares for 21 thresholds 0, 0.05, .. 1; predicted 1 iff p is strictly above.

    The rows are counted once per (number of thresholds below p, y); only that
    small table is expanded over the thresholds.
    """
    cuts = F.array(*[F.lit(k * 0.05) for k in range(THRESHOLDS)])
    below = F.lit(0)
    for k in range(THRESHOLDS):
        below = below + (F.col(p) > k * 0.05).cast("int")
    counts = df.filter(F.col(p).isNotNull()).groupBy(*by, F.col(y).alias("actual"), below.alias("below")).agg(
        F.count("*").alias("n"))
    wide = counts.select("*", F.posexplode(cuts).alias("k", "cut")).groupBy(*by, "actual", "k", "cut").agg(
        F.sum(F.when(F.col("k") < F.col("below"), F.col("n")).otherwise(0)).alias("above"), F.sum("n").alias("all"))
    cells = F.explode(F.array(
        F.struct(F.lit(1).alias("predicted"), F.col("above").alias("n")),
        F.struct(F.lit(0).alias("predicted"), (F.col("all") - F.col("above")).alias("n")),
    )).alias("cell")
    long = wide.select(*by, F.round("cut", 2).alias("threshold"), "actual", cells)
    total = counts.groupBy(*by).agg(F.sum("n").alias("_rows"))
    out = long.select(*by, "threshold", "actual", "cell.predicted", "cell.n")
    joined = out.join(total, list(by)) if by else out.withColumn("_rows", total.scalar())
    return joined.withColumn("share", F.col("n") / F.col("_rows")).drop("_rows")


def classification_report(counts: DataFrame, by=()) -> DataFrame:
    """Precision, recall, F1 and support per label, accuracy, macro and weighted averages.

    ``counts`` is a confusion table (actual, predicted, n); a zero division is 0.
    """
    by = list(by)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = counts.withColumn("_hit", hit).select(*by, F.explode(F.array(
        F.struct(F.col("actual").cast("string").alias("label"), F.col("_hit").alias("hit"),
                 F.col("n").alias("support"), F.lit(0).cast("bigint").alias("named")),
        F.struct(F.col("predicted").cast("string").alias("label"), F.lit(0).cast("bigint").alias("hit"),
                 F.lit(0).cast("bigint").alias("support"), F.col("n").alias("named")),
    )).alias("s")).select(*by, "s.*")
    per = sides.groupBy(*by, "label").agg(
        F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("named").alias("named")
    ).filter("support + named > 0")
    per = per.withColumns({
        "precision": F.coalesce(_ratio("hit", "named"), F.lit(0.0)),
        "recall": F.coalesce(_ratio("hit", "support"), F.lit(0.0)),
    }).withColumn("f1", F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    scores = ["precision", "recall", "f1"]
    avg = per.groupBy(*by).agg(
        F.sum("support").alias("support"), F.sum("hit").alias("hit"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[F.coalesce(_ratio(F.sum(F.col(s) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(f"weighted_{s}")
          for s in scores],
    )
    none = F.lit(None).cast("double")
    rows = [F.struct(F.lit("accuracy").alias("label"), none.alias("precision"), none.alias("recall"),
                     _ratio("hit", "support").alias("f1"), F.lit(None).cast("bigint").alias("support"))]
    rows += [F.struct(F.lit(f"{kind} avg").alias("label"), *[F.col(f"{kind}_{s}").alias(s) for s in scores],
                      F.col("support")) for kind in ("macro", "weighted")]
    tail = avg.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")
    return per.select(*by, "label", *scores, "support").unionByName(tail)


# --- curves over distinct scores -------------------------------------------

def score_counts(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    """Rows and positives per distinct score."""
    return df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).alias("p")).agg(
        F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))


def _cumulative(df, y, p, by, carry=()) -> DataFrame:
    """Per distinct score: tp, fp at that threshold (score >= p) and class sizes."""
    cum = prefix_sums(score_counts(df, y, p, by), "p", ["n", "pos"], by, carry=carry)
    return cum.withColumns({
        "tp": _dbl(F.col("pos_total") - F.col("pos_before")),
        "above": _dbl(F.col("n_total") - F.col("n_before")),
        "positives": _dbl("pos_total"),
        "negatives": _dbl(F.col("n_total") - F.col("pos_total")),
    }).withColumn("fp", F.col("above") - F.col("tp"))


def roc_curve(df: DataFrame, y: str = "y", p: str = "p", by=(), drop_collinear: bool = True) -> DataFrame:
    """FPR and TPR per distinct score plus the origin (threshold null)."""
    by = list(by)
    cum = _cumulative(df, y, p, by, carry=["n", "pos"])
    highest = F.col("n") == F.col("above")
    if drop_collinear:
        lower = F.col("previous")
        bend = (lower["n"] != F.col("n")) | (lower["pos"] != F.col("pos"))
        cum = cum.filter(highest | lower.isNull() | bend)
    point = F.struct(F.col("p").alias("threshold"), _ratio("fp", "negatives").alias("fpr"), _ratio("tp", "positives").alias("tpr"))
    origin = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    points = F.when(highest, F.array(point, origin)).otherwise(F.array(point))
    return cum.select(*by, F.explode(points).alias("r")).select(*by, "r.*")


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    """Trapezoid area under the ROC curve; null when a class is missing."""
    area = F.sum((F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    return _cumulative(df, y, p, by).groupBy(*by).agg(
        F.try_divide(area, F.first("positives") * F.first("negatives")).alias("auc"))


def pr_curve(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    """Precision and recall per distinct score plus the closing point (recall 0, precision 1)."""
    by = list(by)
    point = F.struct(F.col("p").alias("threshold"), _ratio("tp", "above").alias("precision"),
                     _ratio("tp", "positives").alias("recall"), _ratio("positives", "n_total").alias("baseline"))
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                   F.lit(0.0).alias("recall"), _ratio("positives", "n_total").alias("baseline"))
    points = F.when(F.col("n") == F.col("above"), F.array(point, end)).otherwise(F.array(point))
    return _cumulative(df, y, p, by).select(*by, F.explode(points).alias("r")).select(*by, "r.*")


def pr_auc(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    """Trapezoid area under the precision-recall curve (not average precision)."""
    step = _ratio("pos", "positives")
    here = _ratio("tp", "above")
    higher = F.coalesce(_ratio(F.col("tp") - F.col("pos"), F.col("above") - F.col("n")), F.lit(1.0))
    return _cumulative(df, y, p, by).groupBy(*by).agg(F.sum(step * (here + higher) / F.lit(2.0)).alias("auc"))


def mirror(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Labels and scores of class 0: ``1 - y`` and ``1 - p``."""
    return df.withColumns({y: F.lit(1) - F.col(y), p: F.lit(1.0) - F.col(p)})


def fold_mean(metric: DataFrame, value: str = "auc", by=()) -> DataFrame:
    """Unweighted mean of a per-fold metric."""
    return metric.groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"))


def mean_curve(df: DataFrame, curve: str = "roc", y: str = "y", p: str = "p", fold: str = "fold", by=(), points: int = 100) -> DataFrame:
    """The folds' curves averaged vertically: rows (``by``..., x, mean, low, high, folds) for x = 0, 1/points, .., 1.

    ROC curves run straight between their points, the highest one at a jump;
    precision is that of the first threshold that reaches the recall, 1 at
    recall 0. Each distinct score is one stretch of its fold's curve and finds
    the grid positions inside itself, so no window holds a fold and all folds
    are one job. A fold without one of the classes has no curve.
    """
    if curve not in ("roc", "pr"):
        raise ValueError(f"unknown curve: {curve}")
    by = list(by)
    cum = _cumulative(df, y, p, [*by, fold]).filter("positives > 0 AND negatives > 0")
    end, step, total = ("fp", F.col("n") - F.col("pos"), "negatives") if curve == "roc" else ("tp", F.col("pos"), "positives")
    step, count = _dbl(step), F.lit(float(points))
    first = F.ceil((F.col(end) - step) * count / F.col(total))
    last = F.floor(F.col(end) * count / F.col(total))
    if curve == "roc":
        rise = _dbl("pos")
        share = F.coalesce(F.try_divide(F.col("i") * F.col(total) / count - (F.col(end) - step), step), F.lit(1.0))
        value = (F.col("tp") - rise + share * rise) / F.col("positives")
    else:
        value = F.when(F.col("i") == 0, F.lit(1.0)).otherwise(_ratio("tp", "above"))
    inside = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    spots = cum.withColumn("i", F.explode(inside)).withColumn("v", value)
    # A border belongs to two stretches: the higher end of a jump, the first threshold that gets there.
    best = F.max("v") if curve == "roc" else F.max_by("v", "p")
    each = spots.groupBy(*by, fold, "i").agg(best.alias("v"))
    return each.groupBy(*by, (F.col("i") / count).alias("x")).agg(
        F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("folds"))


def fold_scores(df: DataFrame, y: str = "y", p: str = "p", fold: str = "fold", by=()) -> DataFrame:
    """Rows (``by``..., fold, roc_auc, pr_auc, brier), all folds and metrics from one pass over the distinct scores."""
    area = F.sum((F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    higher = F.coalesce(_ratio(F.col("tp") - F.col("pos"), F.col("above") - F.col("n")), F.lit(1.0))
    precision = F.sum(_ratio("pos", "positives") * (_ratio("tp", "above") + higher) / F.lit(2.0))
    score = F.col("p")
    squares = F.sum(F.col("n") * score * score - F.lit(2.0) * F.col("pos") * score + F.col("pos")) / F.sum("n")
    return _cumulative(df, y, p, [*by, fold]).groupBy(*by, fold).agg(
        F.try_divide(area, F.first("positives") * F.first("negatives")).alias("roc_auc"), precision.alias("pr_auc"), squares.alias("brier"))


def fold_tables(df: DataFrame, y: str = "y", p: str = "p", fold: str = "fold", by=()) -> dict[str, DataFrame]:
    """Curves and scores per fold and their means over the folds."""
    by = list(by)
    scores = fold_scores(df, y, p, fold, by)
    return {
        "fold_roc_curve": roc_curve(df, y, p, [*by, fold]), "mean_roc_curve": mean_curve(df, "roc", y, p, fold, by),
        "fold_pr_curve": pr_curve(df, y, p, [*by, fold]), "mean_pr_curve": mean_curve(df, "pr", y, p, fold, by),
        "fold_calibration_curve": calibration_curve(df, y, p, by=[*by, fold]), "fold_scores": scores,
        "fold_means": scores.groupBy(*by).agg(*[F.avg(m).alias(f"mean_{m}") for m in ("roc_auc", "pr_auc", "brier")]),
    }


def calibration_curve(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10, by=(), accuracy: int | None = None) -> DataFrame:
    """Mean score and share of positives in quantile bins of the score; empty bins are absent.

    Edges are exact and interpolated. With ``accuracy`` they come from mergeable
    sketches instead, in one pass without ranks: each is a score whose rank is
    off by at most ``rows / accuracy``. Above ``SKETCH_ACCURACY`` they are the
    scores at those ranks, from counts.
    """
    by = list(by)
    counts = score_counts(df, y, p, by)
    inner = [i / bins for i in range(1, bins)]
    if accuracy:
        known = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
        edges = (known.groupBy(*by).agg(F.percentile_approx(F.col(p), inner, accuracy).alias("edges"))
                 if accuracy <= SKETCH_ACCURACY else discrete_quantiles(known, p, inner, by))
    else:
        edges = quantile_edges(counts, "p", inner, by, weight="n")
    joined = counts.join(edges, by) if by else counts.withColumn("edges", edges.scalar())
    bin_no = count_below("edges", "p", bins - 1)
    return joined.groupBy(*by, bin_no.alias("bin")).agg(
        F.sum("n").alias("n"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_predicted"),
        (F.sum("pos") / F.sum("n")).alias("fraction_positive"))


def brier(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"))


def one_vs_rest(df: DataFrame, y: str, probabilities: dict) -> DataFrame:
    """Rows (class, y, p): one binary problem per class, all in one pass.

    ``probabilities`` maps a class label to its probability column.
    """
    structs = [
        F.struct(F.lit(c).cast("string").alias("class"), (F.col(y) == F.lit(c)).cast("int").alias("y"),
                 F.col(col).alias("p"))
        for c, col in probabilities.items()
    ]
    rest = [c for c in df.columns if c not in {y, *probabilities.values(), "class", "y", "p"}]
    return df.select(*rest, F.explode(F.array(*structs)).alias("r")).select(*rest, "r.*")


# --- distributions -----------------------------------------------------------

def probability_histogram(df: DataFrame, y: str = "y", p: str = "p", width: float = 0.01, by=()) -> DataFrame:
    """Counts and density of the score per actual class in bins of fixed width."""
    last = round(1 / width) - 1
    by = list(by)
    counts = df.filter(F.col(p).isNotNull()).groupBy(
        *by, F.col(y).alias("y"), F.least(F.floor(F.col(p) / F.lit(width)), F.lit(last)).alias("bin")
    ).agg(F.count("*").alias("n"))
    size = counts.groupBy(*by, "y").agg(F.sum("n").alias("_all"))
    return counts.join(size, [*by, "y"]).withColumn(
        "density", F.col("n") / (F.col("_all") * F.lit(width))).drop("_all")


def density_histogram(df: DataFrame, value: str, group: str, bins: int = 50) -> DataFrame:
    """Probability density per group over equal bins between the global minimum and maximum."""
    span = df.agg(F.struct(F.min(_dbl(value)).alias("lo"), F.max(_dbl(value)).alias("hi")).alias("s"))
    rows = df.filter(F.col(value).isNotNull()).withColumn("_s", span.scalar())
    width = (F.col("_s.hi") - F.col("_s.lo")) / F.lit(float(bins))
    place = F.coalesce(F.try_divide(_dbl(value) - F.col("_s.lo"), width), F.lit(0.0))
    counts = rows.groupBy(F.col(group), F.least(F.floor(place), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.first(width).alias("_w"))
    size = counts.groupBy(group).agg(F.sum("n").alias("_all"))
    return counts.join(size, group).withColumn("density", _ratio("n", F.col("_all") * F.col("_w"))).drop("_all", "_w")


def group_distribution(df: DataFrame, feature: str, group: str) -> DataFrame:
    """Summary behind a violin: rows, mean, extremes and exact quartiles per group."""
    spread = quantiles(df, feature, [0.25, 0.5, 0.75], [group]).groupBy(group).agg(*[
        F.max(F.when(F.col("prob") == q, F.col("quantile"))).alias(name)
        for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    ])
    stats = df.filter(F.col(feature).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.avg(feature).alias("mean"), F.min(feature).alias("min"), F.max(feature).alias("max"))
    return stats.join(spread, group)


def _per_group(df: DataFrame, groups: DataFrame, by, columns) -> DataFrame:
    """Attach ``columns`` of the row of ``groups`` with the same ``by`` values.

    Evaluation groups are few (data types, folds), so they come as one array
    value instead of a join on a key that most rows share.
    """
    if not by:
        return df.withColumn("_group", groups.select(F.struct(*columns)).scalar()).select(
            "*", *[F.col(f"_group.{c}").alias(c) for c in columns]).drop("_group")
    listed = groups.agg(F.collect_list(F.struct(*by, *columns)))

    def same(row):
        out = F.lit(True)
        for c in by:
            out = out & row[c].eqNullSafe(F.col(c))
        return out

    found = df.withColumn("_groups", listed.scalar()).withColumn("_group", F.get(F.filter("_groups", same), F.lit(0)))
    return found.select(*df.columns, *[F.col(f"_group.{c}").alias(c) for c in columns])


def prediction_pairs(df: DataFrame, y: str = "y", yhat: str = "prediction", bins: int | None = None, by=()) -> DataFrame:
    """Actual against predicted per group: the points, or counts on a ``bins`` x ``bins`` grid."""
    by = list(by)
    pairs = df.select(*by, F.col(y).alias("actual"), F.col(yhat).alias("predicted"))
    if bins is None:
        return pairs
    span = pairs.groupBy(*by).agg(*[f(_dbl(c)).alias(f"_{k}_{c}") for c in ("actual", "predicted")
                                    for k, f in (("lo", F.min), ("hi", F.max))])
    rows = _per_group(pairs, span, by, [f"_{k}_{c}" for c in ("actual", "predicted") for k in ("lo", "hi")])

    def cell(c):
        width = (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / F.lit(float(bins))
        place = F.coalesce(F.try_divide(_dbl(c) - F.col(f"_lo_{c}"), width), F.lit(0.0))
        return F.least(F.floor(place), F.lit(bins - 1)).alias(f"{c}_bin")

    return rows.groupBy(*by, cell("actual"), cell("predicted")).agg(F.count("*").alias("n"))


# --- regression ----------------------------------------------------------------

def quantile_error(df: DataFrame, y: str = "y", yhat: str = "prediction", bins: int = 20, by=()) -> DataFrame:
    """Box summary of predicted minus actual in quantile bins of the actual value, per group.

    Bins are right-closed, duplicate edges are dropped and the first bin
    includes the minimum. Whiskers reach the last value within 1.5 IQR. Rows
    collapse to counts per bin and difference; quartiles and whiskers read those.
    """
    by = list(by)
    rows = df.select(*by, _dbl(y).alias("y"), (_dbl(yhat) - _dbl(y)).alias("diff")).dropna(subset=["y", "diff"])
    edges = quantile_edges(rows, "y", [i / bins for i in range(bins + 1)], by)
    rows = _per_group(rows, edges.select(*by, F.array_distinct("edges").alias("_edges")), by, ["_edges"])
    rows = rows.withColumn("bin", F.greatest(count_below("_edges", "y", bins + 1), F.lit(1)))
    rows = rows.select(*by, "diff", "bin", F.get("_edges", F.col("bin") - 1).alias("lo"),
                       F.coalesce(F.get("_edges", F.col("bin")), F.get("_edges", F.col("bin") - 1)).alias("hi"))
    # Read by the quartiles and by the whiskers, so written once.
    counts = cut_lineage(rows.groupBy(*by, "bin", "lo", "hi", "diff").agg(F.count("*").alias("n")))
    box = quantiles(counts, "diff", [0.25, 0.5, 0.75], [*by, "bin", "lo", "hi"], weight="n").groupBy(*by, "bin", "lo", "hi").agg(*[
        F.max(F.when(F.col("prob") == q, F.col("quantile"))).alias(name)
        for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    ])
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    inside = F.col("diff").between(F.col("q1") - reach, F.col("q3") + reach)
    boxed = _per_group(counts, box, [*by, "bin"], ["q1", "median", "q3"])
    return boxed.groupBy(*by, "bin", "lo", "hi", "q1", "median", "q3").agg(
        F.sum("n").alias("n"), F.min(F.when(inside, F.col("diff"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("diff"))).alias("upper_whisker"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"))


METRICS = ("mae", "mse", "rmse", "r2", "adj_r2", "mape", "explained_variance", "max_error", "median_ae", "msle", "rmsle")
_EPS = 2.220446049250313e-16


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "prediction", n_features: int = 1, by=(),
                       metrics=METRICS) -> DataFrame:
    """Regression metrics as rows (``by``..., metric, value), from one aggregate.

    Only ``median_ae`` needs ranks; it adds a distributed exact median.
    """
    by = list(by)
    rows = df.select(*by, _dbl(y).alias("y"), _dbl(yhat).alias("h")).filter("y IS NOT NULL AND h IS NOT NULL")
    e = F.col("h") - F.col("y")
    log = F.log1p(F.greatest("h", F.lit(0.0))) - F.log1p(F.greatest("y", F.lit(0.0)))
    one, n = F.lit(1.0), F.count(F.lit(1)).cast("double")
    sse, sst = F.sum(e * e), F.var_pop("y") * n
    r2 = F.coalesce(one - F.try_divide(sse, sst), F.when(sse == 0, one).otherwise(F.lit(0.0)))
    exprs = {
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": r2,
        "adj_r2": one - F.try_divide((one - r2) * (n - one), n - F.lit(float(n_features + 1))),
        "mape": F.avg(F.abs(e) / F.greatest(F.abs("y"), F.lit(_EPS))),
        "explained_variance": F.coalesce(one - F.try_divide(F.var_pop(e), F.var_pop("y")),
                                         F.when(F.var_pop(e) == 0, one).otherwise(F.lit(0.0))),
        "max_error": F.max(F.abs(e)),
        "msle": F.avg(log * log),
        "rmsle": F.sqrt(F.avg(log * log)),
    }
    wanted = [m for m in metrics if m != "median_ae"]
    out = None
    if wanted:
        wide = rows.groupBy(*by).agg(*[exprs[m].alias(m) for m in wanted])
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in wanted])
        out = wide.select(*by, F.explode(pairs).alias("r")).select(*by, "r.*")
    if "median_ae" in metrics:
        middle = quantiles(rows.select(*by, F.abs(e).alias("e")), "e", [0.5], by).select(
            *by, F.lit("median_ae").alias("metric"), F.col("quantile").alias("value"))
        out = middle if out is None else out.unionByName(middle)
    return out


# --- dispatch -------------------------------------------------------------------

def evaluate(df: DataFrame, task: str, target: str, probabilities: dict | None = None, by=("data_type",),
             n_features: int = 1, fold: str | None = None) -> dict[str, DataFrame]:
    """Every table that fits the task, one job each, all groups of ``by`` together.

    ``df`` holds the target, ``prediction`` and the probability columns;
    ``probabilities`` maps class labels to them (binary: one positive label).
    ``fold`` names the column of the fold a row was tested in (null: in none);
    classifications then also get tables per fold and over the folds.
    """
    by, more = list(by), [fold] if fold else []
    if task == "regression":
        return {
            "prediction_pairs": prediction_pairs(df, target, bins=100, by=by),
            "quantile_error": quantile_error(df, target, by=by),
            "regression_metrics": regression_metrics(df, target, n_features=n_features, by=by),
        }
    out = {"confusion_matrix": confusion_matrix(df, target, by=by)}
    if task == "binary":
        ((label, column),) = probabilities.items()
        rows = df.select(*by, *more, (F.col(target) == F.lit(label)).cast("int").alias("y"), F.col(column).alias("p"))
        out["confusion_by_threshold"] = confusion_by_threshold(rows, by=by)
        out["classification_report"] = classification_report(out["confusion_by_threshold"], [*by, "threshold"])
        out["pr_curve_class_0"] = pr_curve(mirror(rows), by=by)
        out["pr_auc_class_0"] = pr_auc(mirror(rows), by=by)
    else:
        rows = one_vs_rest(df.select(*by, *more, target, *probabilities.values()), target, probabilities)
        out["classification_report"] = classification_report(out["confusion_matrix"], by)
        by = [*by, "class"]
    out |= {
        "roc_curve": roc_curve(rows, by=by), "roc_auc": roc_auc(rows, by=by),
        "pr_curve": pr_curve(rows, by=by), "pr_auc": pr_auc(rows, by=by),
        "calibration_curve": calibration_curve(rows, by=by), "brier": brier(rows, by=by),
        "probability_histogram": probability_histogram(rows, by=by),
    }
    if fold:
        out |= fold_tables(rows.filter(F.col(fold).isNotNull()), fold=fold, by=by)
    return out
