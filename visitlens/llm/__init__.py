"""Operators for preparing training text. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions that run there travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
