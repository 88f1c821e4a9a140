"""Operators for preparing training data; nothing outside this folder imports them.

Functions that run in tasks are sent along with their code, so that executors need not
have this folder on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
