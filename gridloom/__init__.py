"""Gridloom: Spark jobs for regional hourly series and for training-data corpora."""
