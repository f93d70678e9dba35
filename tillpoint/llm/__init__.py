"""Operators of a training-data pipeline over document tables.

One module per operator; ``queries.py`` registers the thin ``opN_*`` queries.
Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value: they need the
# libraries there, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
