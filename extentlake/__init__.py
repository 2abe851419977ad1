"""extentlake: Spark-native analytics over an extent-based, XOR-protected storage pool."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors need no copy of the package: what their Python workers run travels with the task.
register_pickle_by_value(sys.modules[__name__])
