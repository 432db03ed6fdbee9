"""Registered queries over the given tables, with SQL counterparts."""

import sys

from pyspark import cloudpickle

# The stand-in models travel by value, as the package's own helpers do.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
