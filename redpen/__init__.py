"""Spark-native engine for grammatical-error-correction corpora."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel inside the pickled function, so executors need
# numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
