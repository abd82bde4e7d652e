"""Spark jobs that turn timestamped event streams into inferred hidden state, and back into tables."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so that a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
