"""docloom: documentation-corpus and change-log analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
