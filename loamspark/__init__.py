"""A PySpark-native analytics engine: corpus ETL, retrieval, graph, metrics and traces.

Functions of this package run inside Python workers, so they are pickled by value: executors
need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
