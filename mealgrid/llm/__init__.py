"""Preparation of training text for language models at corpus scale; nothing else in the library imports this.

The Python functions that run in tasks travel with the job, so workers need no install of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
