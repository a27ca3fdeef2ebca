"""Table profiling, quality, insight and corpus jobs written as plain Spark DataFrame code."""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

# Helpers used inside tasks travel with the job, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
