"""starloom: survey-scale sky-image analytics as Spark DataFrame programs."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Task bodies travel with the job, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
