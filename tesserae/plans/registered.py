"""All registered queries and their SQL."""

from tesserae.plans import catalogue, files, grids, imaging, storing, telemetry

QUERIES = catalogue.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL
MODULES = (catalogue, files, grids, imaging, storing, telemetry)
