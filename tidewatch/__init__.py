"""Event correlation on Spark: windows, rules, joins, streaming and synthetic scenarios."""

import sys

from pyspark import cloudpickle

# What Python workers run travels with its code, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
