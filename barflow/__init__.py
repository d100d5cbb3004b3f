"""barflow: market and event time-series analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped by value, so executors do not need
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
