"""Tessella: DataFrame-first curation and corpus analytics on Apache Spark."""
