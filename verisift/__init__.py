"""Article-veracity analytics as Spark DataFrame, SQL and ML jobs."""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel inside their jobs, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
