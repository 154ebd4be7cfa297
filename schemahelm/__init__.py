"""Spark-native schema registry, drift and governance operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the few Python helpers inside the task closures, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
