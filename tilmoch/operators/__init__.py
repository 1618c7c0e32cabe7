"""Operators on tables: spans, corpus, metrics, reports."""
