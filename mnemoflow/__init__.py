"""Spark-native engine for conversational memory; the subpackages hold its operators."""

import sys

from pyspark import cloudpickle

# Executors get our Python functions with each job, so the package need not be installed on every machine.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
