"""Event-level feature tables, matched controls and audits as PySpark DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
