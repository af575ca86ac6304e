"""Composed plans: canonical tables, evaluation and the registered queries."""
