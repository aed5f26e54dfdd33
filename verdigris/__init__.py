"""A PySpark-native engine for evaluation data and corpus preparation.

Functions that run on executors are pickled by value, so workers need neither
this package nor a shared source folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
