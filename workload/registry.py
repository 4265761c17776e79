"""The registered queries. Each is a function of (spark, folder of the tables)."""

from __future__ import annotations

from workload import answers, catalogue_queries, grids, imagery, language, more, quality

QUERIES = {**imagery.QUERIES, **grids.QUERIES, **quality.QUERIES, **language.QUERIES, **catalogue_queries.QUERIES,
           **answers.QUERIES, **more.QUERIES}
