"""Review intelligence and retrieval evaluation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the small Arrow/pandas kernels with the task, so that executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
