"""Session settings that scoring depends on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# HotSpot never compiles a method above 8,000 bytes of bytecode, and a model with
# many bins easily makes one. At this limit Spark runs such stages operator by
# operator instead, with the expressions split into small compiled methods.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def with_small_methods(df: DataFrame) -> DataFrame:
    """The same DataFrame, in a session that does not run oversized generated methods.

    A limit that the user lowered further is left alone.
    """
    conf = df.sparkSession.conf
    if int(conf.get(METHOD_LIMIT[0], "65535")) > int(METHOD_LIMIT[1]):
        conf.set(*METHOD_LIMIT)
    return df


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, whatever folder they start in."""
    import glasswork

    root = os.path.dirname(os.path.dirname(os.path.abspath(glasswork.__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
