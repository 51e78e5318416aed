"""Operators for training-data pipelines, and their registered queries.

Task functions are sent to the executors with their code, so nothing has to be installed there
but the libraries they use.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
