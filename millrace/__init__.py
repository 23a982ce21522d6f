"""Curation, ranking, preference-pairing and evaluation analytics on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors with their code, so that the
# package need not be installed there or lie on the workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
