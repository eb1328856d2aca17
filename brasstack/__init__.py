"""brasstack: building and scoring evaluation datasets as Spark plans."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# executors need no copy of this package: its functions travel with the plans
register_pickle_by_value(sys.modules[__name__])
