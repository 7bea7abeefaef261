"""Operators: harmonisation, marts, dimensions, quality, coverage, reports, load job."""
