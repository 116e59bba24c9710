"""loomwright: a Spark-first engine for preparing and scoring text and code corpora."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
