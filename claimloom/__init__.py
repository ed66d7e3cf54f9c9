"""Evidence-graph analytics and corpus preparation on PySpark.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame in, DataFrame out), ``plans`` (composite
plans), ``sources`` (readers, writers, scratch tables), ``streaming`` (structured-streaming facades).
"""
