"""Workforce-retention analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from stayscope.schema import HR, Roles

# The few functions that run in Python workers travel with their code, so a cluster's executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["HR", "Roles"]
