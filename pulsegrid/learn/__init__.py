"""Learners: numpy models that fit one fold in one task, pyspark.ml pipelines for large tables, gates, fusion and evaluation."""
