"""Registration helper, table access and the fixed models that several areas score with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glasswork.models import AdditiveModel, LinearModel, Node, TreeModel
from glasswork.models import category_axis, numeric_axis, pair_term, single_term


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def query(self, name: str, sql: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


BINARY = AdditiveModel(
    name="returned", task="binary", target="y", intercept=(-0.6931,), classes=(0, 1),
    terms=(
        single_term("l_quantity", "numeric", numeric_axis([5.5, 12.0, 25.0, 40.0]),
                    [0.05, -0.31, -0.12, 0.0, 0.14, 0.27]),
        single_term("l_discount", "numeric", numeric_axis([0.015, 0.045, 0.075]),
                    [0.0, 0.21, 0.08, -0.06, -0.24]),
        single_term("l_linestatus", "categorical", category_axis(["F", "O"]), [0.0, 0.33, -0.29]),
    ),
)

PAIR = pair_term(
    ("l_quantity", "l_linestatus"), ("numeric", "categorical"),
    (numeric_axis([10.0, 20.0, 35.0]), category_axis(["F", "O"])),
    [[0.01, 0.02, 0.03], [0.1, -0.2, 0.3], [0.11, -0.21, 0.31], [0.12, -0.22, 0.32], [0.13, -0.23, 0.33]],
)

PRICE = AdditiveModel(
    name="price", task="regression", target="l_extendedprice", intercept=(52000.0,),
    terms=(
        # More bins than the flat CASE limit, so this term renders as a balanced tree.
        single_term("l_quantity", "numeric", numeric_axis([q + 0.5 for q in range(1, 50)]),
                    [0.0, *[(q - 25.5) * 2010.5 for q in range(1, 51)]]),
        single_term("l_tax", "numeric", numeric_axis([0.025, 0.055]), [0.0, -35.5, 12.25, 20.75]),
        pair_term(("l_discount", "l_tax"), ("numeric", "numeric"),
                  (numeric_axis([0.05]), numeric_axis([0.04], missing=False)),
                  [[0.0, 0.0], [3.5, -2.5], [-4.25, 1.75]]),
    ),
)

FLAGS = ("A", "N", "R")
MULTI = AdditiveModel(
    name="flag", task="multiclass", target="l_returnflag", classes=FLAGS, intercept=(-0.2, 0.3, -0.1),
    terms=(
        single_term("l_quantity", "numeric", numeric_axis([15.0, 35.0]),
                    [(0.0, 0.0, 0.0), (0.2, -0.1, 0.05), (0.0, 0.15, -0.05), (-0.3, 0.1, 0.25)]),
        single_term("l_linestatus", "categorical", category_axis(["F", "O"]),
                    [(0.0, 0.0, 0.0), (0.4, -0.6, 0.35), (-0.45, 0.5, -0.4)]),
    ),
)

LINEAR = LinearModel("price_line", "regression", "l_extendedprice", ("l_quantity", "l_discount"),
                     (1250.5,), ((2047.25, -815.5),))
LOGIT = LinearModel("returned_line", "binary", "y", ("l_quantity", "l_discount", "l_tax"),
                    (-0.75,), ((0.0125, -1.5, 2.25),), (0, 1))
SOFTMAX = LinearModel("flag_line", "multiclass", "l_returnflag", ("l_quantity", "l_tax"), (0.1, -0.2, 0.05),
                      ((0.011, -0.5), (-0.004, 1.5), (0.002, 0.25)), FLAGS)

TREE = TreeModel(
    name="flag_tree", task="multiclass", target="l_returnflag", features=("l_quantity", "l_discount"), classes=FLAGS,
    nodes=(
        Node(0, (20.0, 40.0, 20.0), 80.0, "l_quantity", 24.5, 1, 2, 0.2),
        Node(1, (15.0, 10.0, 5.0), 30.0, "l_discount", 0.045, 3, 4, 0.1),
        Node(2, (5.0, 30.0, 15.0), 50.0),
        Node(3, (12.0, 5.0, 2.0), 19.0),
        Node(4, (3.0, 5.0, 3.0), 11.0),
    ),
)
PRICE_TREE = TreeModel(
    name="price_tree", task="regression", target="l_extendedprice", features=("l_quantity", "l_tax"),
    nodes=(
        Node(0, (52000.0,), 100.0, "l_quantity", 25.5, 1, 2, 9.0),
        Node(1, (27000.5,), 50.0, "l_quantity", 12.5, 3, 4, 4.0),
        Node(2, (78000.25,), 50.0, "l_tax", 0.045, 5, 6, 0.5),
        Node(3, (14000.75,), 25.0),
        Node(4, (40000.5,), 25.0),
        Node(5, (77500.125,), 25.0),
        Node(6, (78500.5,), 25.0),
    ),
)

# Binary scores of every lineitem row, six decimals, as rows (y, p); used by the evaluation area.
SCORED_SQL = """(
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_linenumber % 5 AS fold,
         ROUND(1E0 / (1E0 + EXP(-(-0.6931E0
           + CASE WHEN l_quantity <= 5.5 THEN -0.31E0 WHEN l_quantity <= 12 THEN -0.12E0
                  WHEN l_quantity <= 25 THEN 0E0 WHEN l_quantity <= 40 THEN 0.14E0 ELSE 0.27E0 END
           + CASE WHEN l_discount <= 0.015E0 THEN 0.21E0 WHEN l_discount <= 0.045E0 THEN 0.08E0
                  WHEN l_discount <= 0.075E0 THEN -0.06E0 ELSE -0.24E0 END
           + CASE WHEN l_linestatus = 'F' THEN 0.33E0 WHEN l_linestatus = 'O' THEN -0.29E0 ELSE 0E0 END))), 6) AS p
  FROM lineitem)"""


def scored(spark, sf_dir: str) -> DataFrame:
    """Rows (y, fold, p): every lineitem row scored with the fixed binary model."""
    from glasswork.operators.score import score

    li = table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_discount", "l_linestatus",
        (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_linenumber") % 5).alias("fold"),
    )
    return score(li, BINARY).select("y", "fold", r6("probability").alias("p"))
