"""corelens: multi-dimensional core search and corpus operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so no executor needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
