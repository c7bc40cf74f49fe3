"""Sequence analytics on Spark: k-mers, screening, graphs, statistics."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
