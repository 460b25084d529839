"""Data-quality validation, grouping, repair and promotion as Spark DataFrame plans."""
