"""Form-table analytics as DataFrame-to-DataFrame Spark operators."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the workers by value, so a cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
