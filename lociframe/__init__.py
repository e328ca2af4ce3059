"""Interval, sequence, motif, dataset, evaluation and log operators over Spark DataFrames."""

from lociframe.session import checkpoint_dir, configure

__all__ = ["checkpoint_dir", "configure"]

# Functions sent to Python workers travel by value, so a session started from any folder can run them.
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
