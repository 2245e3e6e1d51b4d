"""Spark toolkit for analysing designed experiments on large tables."""
