"""Whole programs: extraction and matching."""
