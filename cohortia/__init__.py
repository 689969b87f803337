"""DataFrame operators for long-format measurement cohorts on Spark."""

import sys

from pyspark import cloudpickle

from cohortia.cohort import Cohort

# Executors need no copy of the package: functions sent to them carry their code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Cohort"]
