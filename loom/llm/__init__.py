"""Operators of a training-data pipeline on text tables (nothing else in the library imports this subpackage).

Functions that run inside tasks travel to the executors by value, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
