"""Glasswork: interpretable modelling on Spark DataFrames.

Profile and clean a labelled table, measure association, build folds, fit
additive, linear and tree models, keep each fitted model as a small lookup
table, and score rows with plain Spark expressions or exported SQL text.
"""

import sys

from pyspark import cloudpickle

from glasswork.models import AdditiveModel, Cell, LinearModel, Node, Term, TreeModel

__all__ = ["AdditiveModel", "Cell", "LinearModel", "Node", "Term", "TreeModel"]

# Functions sent to Python workers travel by value: executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
