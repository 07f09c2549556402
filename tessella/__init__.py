"""Spark-native analytics over software-architecture models.

Every relation carries a ``model`` key so that one job covers many models.
"""
