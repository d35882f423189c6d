"""The library's queries over the driver tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from memlake.plans import evaluation, grading, knowledge, lifecycle, memory, prefetch, retrieval, review, scalars, scoring

_MODULES: tuple[ModuleType, ...] = (retrieval, knowledge, evaluation, lifecycle, scalars, prefetch, memory, grading, review, scoring)

#: Each module names its queries; a query's SQL is the constant of its name in capitals, if it has any.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: getattr(m, name) for m in _MODULES for name in m.NAMES}
ORACLES: dict[str, str] = {name: getattr(m, name.upper()) for m in _MODULES for name in m.NAMES if hasattr(m, name.upper())}
