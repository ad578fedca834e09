"""Queries of the library's operators over the driver's tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_execution, catalog_files, catalog_forms, catalog_records, catalog_scopes, catalog_text

FLAGSHIP = "goals_from_findings"
_MODULES = (catalog_text, catalog_records, catalog_execution, catalog_files, catalog_scopes, catalog_forms)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
