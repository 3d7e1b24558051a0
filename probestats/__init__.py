"""Case/control statistics over very wide numeric matrices, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions travel with their tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
