"""Whole routes: from capture files to findings and run records, and from a history to a comparison."""
