"""Operators for training-data corpora: one module per operator, ``queries`` registers them.

Functions of this subpackage run inside Spark tasks; they travel by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
