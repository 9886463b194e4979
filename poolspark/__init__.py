"""Pari-mutuel football pool analytics as Spark DataFrame operators."""
