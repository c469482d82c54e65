"""Layer-wise graph inference on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
