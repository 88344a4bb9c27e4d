"""Corpus and telemetry analytics expressed as Spark DataFrame operators."""
