"""Spark-first selection, evaluation and corpus analytics."""
