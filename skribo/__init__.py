"""skribo: text analytics on Spark DataFrames.

Executors need no copy of the package: what it runs in Python workers is sent to them with the query.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
