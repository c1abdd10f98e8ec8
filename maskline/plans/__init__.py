"""Whole jobs: de-identification, scoring, reports, and the query catalogue."""
