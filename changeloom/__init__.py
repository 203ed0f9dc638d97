"""Analytics over source-code changes and training corpora, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python functions that tasks run travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
