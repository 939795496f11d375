"""Behaviour analytics over user activity logs as PySpark DataFrame operators."""
