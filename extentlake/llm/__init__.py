"""Operators for large-scale training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors need no copy of the package: what their Python workers run travels with the task.
register_pickle_by_value(sys.modules[__name__])
