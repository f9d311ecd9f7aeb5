"""Group-aware splitting, leakage and distribution-shift analytics on Spark DataFrames.

Every public function takes DataFrames plus column names and returns a lazily
evaluated DataFrame, so the pieces compose with ``df.transform``.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The small kernels that run in Python workers travel with their code, so executors
# need numpy, pandas and pyarrow but no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
