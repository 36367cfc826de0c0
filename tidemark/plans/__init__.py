"""Whole jobs: ingest, cluster, feed."""
