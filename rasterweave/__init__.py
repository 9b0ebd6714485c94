"""Time series of raster frames with gaps, as ordinary Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel by value, so that executors need only
# PySpark, numpy and pandas, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
