"""Rollout analytics on Spark: rewards, advantages, importance ratios, evaluation reports."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# the small Python helpers travel with their tasks, so executors need no copy of the package
register_pickle_by_value(sys.modules[__name__])
