"""Operators of a large training-data pipeline; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
