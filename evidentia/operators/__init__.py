"""Relational operators and detectors over the chunk view."""
