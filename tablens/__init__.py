"""Data profiling and exploratory analysis as Spark jobs."""

import sys

from pyspark import cloudpickle

from .plans import Dataset, auto_plan, profile, run_tasks

# functions sent to executors carry their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Dataset", "auto_plan", "profile", "run_tasks"]
