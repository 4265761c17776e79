"""SQL checks of the registered queries, one statement each."""

from __future__ import annotations

from workload import answers_sql, catalogue_sql, grids_sql, imagery_sql, language_sql, more_sql, quality_sql

ORACLE = {**imagery_sql.ORACLE, **grids_sql.ORACLE, **quality_sql.ORACLE, **language_sql.ORACLE, **catalogue_sql.ORACLE,
          **answers_sql.ORACLE, **more_sql.ORACLE}
