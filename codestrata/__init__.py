"""codestrata: source-corpus analytics as Spark DataFrame jobs."""

from pyspark import cloudpickle

from .functions import jsparse, pyparse, splitter, structure
from .operators import knn
from .sources import tree

# Functions that run inside tasks travel by value, so executors need no copy of this package.
for _module in (pyparse, jsparse, splitter, structure, knn, tree):
    cloudpickle.register_pickle_by_value(_module)
