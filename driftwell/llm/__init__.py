"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

Its functions travel to executors by value, so that workers need not have the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
