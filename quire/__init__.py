"""quire: a PySpark engine for page-layout analysis and training-data preparation."""
