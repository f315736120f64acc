"""tidelog: a Spark-native engine for versioned key-value mutation logs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors get the functions that they run by value, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
