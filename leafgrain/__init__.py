"""Document knowledge as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Ship the package's own functions inside tasks, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
