"""Spark-native analytics for vehicle trips on street networks."""

import sys

from pyspark import cloudpickle

# Python kernels travel inside the plan, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
