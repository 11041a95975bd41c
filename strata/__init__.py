"""strata — tabular analytics and modelling operators on Spark DataFrames.

Every operator takes and returns DataFrames (lazy); the only eager points are
fitted statistics (one aggregate collected as a small dict), model fits and
the level-synchronous loops of the route and tree operators.
"""

__version__ = "0.1.0"
