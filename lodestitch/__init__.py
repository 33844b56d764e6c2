"""Spark-native record linkage and corpus preparation.

``functions`` holds column expressions, ``operators`` DataFrame-to-DataFrame operators, ``plans`` whole queries,
``sources`` readers and writers, ``streaming`` the micro-batch entry points.
"""

__all__ = ["session"]
