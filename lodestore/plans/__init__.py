"""Registered queries: operators applied to the tables, each with its SQL."""
