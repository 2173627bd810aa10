"""Tri-state feature analytics on Spark DataFrames.

Functions of this package that run in Python workers are pickled by value, so executors need
nothing installed beside PySpark, pyarrow and numpy.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
