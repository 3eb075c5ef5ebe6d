"""Operators for preparing training text; nothing else in the library imports them.

Functions of this subpackage that run in Python workers are sent to them by value, so
the workers need not have the library installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
