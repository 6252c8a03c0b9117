"""tsfoundry: probabilistic time-series analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from tsfoundry.session import configure, get_spark

__all__ = ["configure", "get_spark"]

# Functions that run in Python workers travel with the job, so executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
