"""Training-data operators.

Nothing outside this folder imports it. Python functions of this subpackage
travel to the executors by value, so a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
