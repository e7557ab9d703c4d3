"""Spark-native analytics around training image and vector classifiers.

``functions``  column expressions (activations, costs, array and text helpers)
``operators``  DataFrame -> DataFrame operators (joins, scans, sets, reports)
``sources``    readers and writers for labelled array datasets and event logs
``plans``      multi-job work: scoring, training, checkpoints, the profile store
``streaming``  incremental mirror of the profile store and running bests
``contract``   the registered queries and their SQL counterparts
"""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
