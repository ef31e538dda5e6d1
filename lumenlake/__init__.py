"""Media-library analytics on Spark: search, grouping, ranking, clustering and catalog upkeep as DataFrame operators."""
