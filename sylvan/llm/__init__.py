"""Operators for building text training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions for Python workers travel with their code, so that workers need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
