"""Freight paperwork analytics as Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

from waybridge.session import build_session, durable_dir

# Functions that run on executors travel with the job, so that workers need no
# installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "durable_dir"]
