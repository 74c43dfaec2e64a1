"""Multi-party interaction analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
