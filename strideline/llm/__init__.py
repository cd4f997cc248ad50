"""Corpus preparation for language-model training: ten operators as Spark jobs."""
