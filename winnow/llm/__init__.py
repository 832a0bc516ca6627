"""Operators of a training-data pipeline, their queries and the SQL they are checked against.

Nothing else in the library imports this package. Functions that run in Python workers are pickled
by value, so the workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
