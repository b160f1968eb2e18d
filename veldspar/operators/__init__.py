"""Operators: search, clustering, index, scoring, evaluation."""
