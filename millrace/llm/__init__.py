"""Operators for preparing training corpora. Nothing else in the library imports this subpackage.

The functions that run in tasks are shipped by value, so executors need not have the library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
