"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole: these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
