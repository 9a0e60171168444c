"""siftwork: a PySpark-native engine for document, event and relational analytics.

Functions that go to executors are pickled by value, so a cluster needs no copy
of the package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
