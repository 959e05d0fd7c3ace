"""Set-at-a-time casework analytics on Spark: documents in, decided cases out."""

import sys

from pyspark import cloudpickle

# Task code travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
