"""A PySpark engine for analysing and maintaining Markdown corpora."""
