"""cloakstone: de-identification, leak audit and two-arm trial statistics as Spark jobs.

Every operator takes and returns DataFrames.  Results carry names, counts, rates,
offsets and hashes; a cell value leaves an operator only under ``reveal=True``.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Ship the package's own functions inside the task, so executors need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
