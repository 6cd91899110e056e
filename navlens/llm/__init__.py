"""Operators of a large-scale training-data pipeline (nothing else in the library imports this package).

Functions of this package that run in Python workers are sent to them by
value, so that the workers need not have the library installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
