"""Evaluation analytics on Spark: curate question sets, sample them, grade answers, report results."""
