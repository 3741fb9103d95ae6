"""Behavioural-sequence analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so a worker does not need this
# package on its own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
