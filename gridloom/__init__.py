"""Gridded climate analytics as plain Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions handed to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
