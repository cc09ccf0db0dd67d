"""Queries: the operators applied to whole tables, and the same in SQL."""
