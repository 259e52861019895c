"""All queries of the profile engine by name, with DuckDB SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitaframe.plans import more, pages, profiles, relational, reports, runners, scalars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**scalars.QUERIES, **relational.QUERIES, **profiles.QUERIES, **more.QUERIES, **reports.QUERIES, **runners.QUERIES, **pages.QUERIES}
ORACLE_SQL: dict[str, str] = {**scalars.ORACLE_SQL, **relational.ORACLE_SQL, **profiles.ORACLE_SQL, **more.ORACLE_SQL, **reports.ORACLE_SQL, **runners.ORACLE_SQL, **pages.ORACLE_SQL}
FLAGSHIP = "e03_ranking"
