"""Item matching on Spark: normalise, embed, store and match large item tables."""

import sys

from pyspark import cloudpickle

from kinmatch.operators.search import MatchOptions, MatchResult, match
from kinmatch.plans.spec import Clause, SearchSpec, item_schema

# Task functions travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Clause", "MatchOptions", "MatchResult", "SearchSpec", "item_schema", "match"]
