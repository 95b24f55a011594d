"""Spark-native analytics over security logs.

Every operator is a plain function from DataFrames (plus parameters) to a DataFrame.
Time never comes from the wall clock inside an operator: callers pass ``as_of`` or
``reference_time``, so a query gives the same answer whenever it runs.
"""

from palisade.session import build_session, configure

__all__ = ["build_session", "configure"]
