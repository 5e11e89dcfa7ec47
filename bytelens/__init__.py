"""bytelens: a PySpark-native analytics engine for compiled bytecode archives."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: functions are shipped by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
