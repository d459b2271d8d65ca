"""strandline: a PySpark-native engine for revision, request-log and text data.

Subpackages: ``functions`` (Column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and sinks), ``plans`` (named queries with their
SQL), ``streaming`` (Structured Streaming forms), and the optional ``llm``
subpackage (training-text operators), which nothing else here imports.
"""
