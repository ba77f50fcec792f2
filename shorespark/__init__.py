"""Spark-native shoreline-change analytics: every operator takes and returns DataFrames."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Worker functions travel by value, so executors need no copy of this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
