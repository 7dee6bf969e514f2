"""Spark-native document-corpus analytics.

The package is pickled by value so that functions sent to Python workers need
no copy of it on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
