"""Decision trees, lowered from the built-in learners to a node table."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from glasswork.functions import scoring as sc
from glasswork.models import Node, TreeModel
from glasswork.operators.additive import target_classes
from glasswork.operators.linear import assembled, class_index
from glasswork.operators.score import leaf_ids


def _nodes(fitted, features) -> tuple[Node, ...]:
    """Nodes in preorder; a node table has the size of the tree."""
    out = []

    def walk(java) -> int:
        at = len(out)
        out.append(None)
        stats = [float(x) for x in java.impurityStats().stats()]
        rows = float(java.impurityStats().count())
        if java.subtreeDepth() == 0:
            value = tuple(stats) if fitted.hasClasses else (float(java.prediction()),)
            out[at] = Node(at, value, rows)
            return at
        split = java.split()
        left, right = walk(java.leftChild()), walk(java.rightChild())
        value = tuple(stats) if fitted.hasClasses else (float(java.prediction()),)
        out[at] = Node(at, value, rows, features[split.featureIndex()], float(split.threshold()), left, right,
                       float(java.gain()))
        return at

    walk(fitted._java_obj.rootNode())
    return tuple(out)


def _nulls_right(df: DataFrame, features) -> DataFrame:
    """Doubles with nulls moved past the column's maximum, by its range or one."""
    if not features:
        return df
    values = df.withColumns({f: F.col(f).cast("double") for f in features})
    row = values.agg(*[F.max(f) for f in features], *[F.min(f) for f in features]).first()
    above = {}
    for i, f in enumerate(features):
        high, low = row[i], row[len(features) + i]
        above[f] = 0.0 if high is None else high + max(high - low, 1.0, abs(high) * 1e-6)
    return values.fillna(above)


def fit_tree(df: DataFrame, target: str, features, task: str, name: str = "decision_tree", max_depth: int = 8,
             max_bins: int = 256, min_rows: int = 1, min_gain: float = 0.0, seed: int = 42,
             classes: tuple = ()) -> TreeModel:
    """CART on numeric features; one pass over the rows per level.

    The rows are read twice: for the range of the features, and into a cache
    that the learner's passes read, which moves to disk where memory is short.

    A null goes right at every split, in the fit as in scoring: it is fitted as
    a value above all others of its column.
    """
    features = tuple(features)
    df = _nulls_right(df.select(*dict.fromkeys([*features, target])), [f for f in features if f != target])
    options = dict(featuresCol="_features", labelCol="_label", maxDepth=max_depth, maxBins=max_bins,
                   minInstancesPerNode=min_rows, minInfoGain=min_gain, seed=seed)
    if task == "regression":
        learner, label = DecisionTreeRegressor(**options), F.col(target).cast("double")
    else:
        classes = classes or target_classes(df, target)
        learner, label = DecisionTreeClassifier(impurity="gini", **options), class_index(target, classes)
    # No null is left in a feature, so none needs to be counted; a target among the features is still checked.
    rows = assembled(df, features, label, "error" if target in features else "drop")
    if task != "regression":
        # The learner need not read all rows to know the number of classes.
        rows = rows.withColumn("_label", F.col("_label").alias("_label", metadata={"ml_attr": {"type": "nominal", "num_vals": len(classes)}}))
    rows = rows.persist()
    try:
        fitted = learner.fit(rows)
    finally:
        rows.unpersist()
    fitted.hasClasses = task != "regression"
    return TreeModel(name, task, target, features, _nodes(fitted, features), tuple(classes))


def gini_importance(spark: SparkSession, model: TreeModel) -> DataFrame:
    """Share of the impurity decrease per feature, from the node table; unused features are left out."""
    rows = [(n.feature, n.gain * n.rows) for n in model.nodes if n.feature is not None and n.gain * n.rows > 0]
    sums = spark.createDataFrame(rows, "feature string, gain double").groupBy("feature").agg(F.sum("gain").alias("gain"))
    total = sums.agg(F.sum("gain")).scalar()
    return sums.select("feature", F.try_divide("gain", total).alias("importance"))


def leaf_class_coverage(df: DataFrame, model: TreeModel) -> DataFrame:
    """Rows (class, leaves, covered): of how many reached leaves each class is the tree's majority.

    Classes come from the table, so one that no leaf predicts shows up as not covered.
    """
    majority = sc.tree_text(model, lambda n: sc.leaf_text(model, n))
    reached = leaf_ids(df, model).select("leaf", F.expr(majority).cast("string").alias("class")).distinct()
    per = reached.groupBy("class").agg(F.count("*").alias("leaves"))
    classes = df.filter(F.col(model.target).isNotNull()).select(F.col(model.target).cast("string").alias("class")).distinct()
    out = classes.join(per, "class", "left").withColumn("leaves", F.coalesce("leaves", F.lit(0).cast("bigint")))
    return out.withColumn("covered", F.col("leaves") > 0)
