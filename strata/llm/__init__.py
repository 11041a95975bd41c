"""Operators of a training-data pipeline. Nothing else in the library imports
this subpackage; ``queries`` registers its ``opN_*`` queries.

Task functions are pickled by value, so executors need numpy, pyarrow and the
tokenizer files, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def register() -> None:
    """Add the queries of this subpackage to the registry."""
    from . import queries  # noqa: F401 - registers on import
