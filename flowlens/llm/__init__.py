"""Operators that prepare training text.

The functions here that run in Python workers travel inside the task, so an
executor needs numpy and pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
