"""vigilo: sensor-event scoring and nutrition analytics on Spark.

Subpackages: ``functions`` (column expressions), ``operators``
(DataFrame -> DataFrame), ``sources`` (table bindings, lake and topic I/O),
``streaming`` (Structured Streaming flows), ``plans`` (named queries, their
oracle SQL and the MLlib pipelines).
"""
