"""Operators over intervals, series, texts, vectors and graphs."""
