"""Call-transcript analytics on Spark DataFrames.

Functions defined here travel to the executors by value, so the workers need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
