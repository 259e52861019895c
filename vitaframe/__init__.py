"""Spark-native extraction, normalisation and scoring of structured profiles."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions go to the executors by value, so that those need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
