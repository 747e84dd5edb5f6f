"""Operators for training-data pipelines; nothing else in the library imports them.

Functions that run on the workers are pickled by value, so an executor needs no copy
of this package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
