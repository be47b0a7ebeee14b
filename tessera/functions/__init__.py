"""The scalar function library, as Spark SQL functions that Catalyst inlines."""

from .library import FUNCTIONS, call, expression, java_date_pattern, names, register

__all__ = ["FUNCTIONS", "call", "expression", "java_date_pattern", "names", "register"]
