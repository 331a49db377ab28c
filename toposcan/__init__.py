"""toposcan: place-name and terrain analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
