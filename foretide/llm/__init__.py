"""Operators of a training-data pipeline over document tables.

Functions of this subpackage travel to the executors by value, so a job needs no copy of
the library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
