"""Registered queries: operators applied to tables derived from the given ones, and their SQL."""
