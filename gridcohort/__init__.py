"""Gridded monthly series linked to individual records, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value: a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
