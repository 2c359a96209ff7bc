"""Spark-native catalog matching: text normalisation, blocking, pair scoring, decisions and evaluation as DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions go to the executors with their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
