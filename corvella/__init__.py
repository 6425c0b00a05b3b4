"""corvella: hybrid document retrieval and data preparation on PySpark.

Every public function takes and returns DataFrames.  Functions that run in
Python workers travel by value, so executors need only the third-party
libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
