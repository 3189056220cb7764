"""Scans, scores, reports: what is composed of the operators."""
