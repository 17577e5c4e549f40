"""Student-progress and ratings analytics as lazy PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# The few pandas helpers travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
