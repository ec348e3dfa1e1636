"""Retrieval analytics on Spark: chunking, ranking, evaluation, answers, policies."""
