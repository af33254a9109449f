"""Registered queries: one per operator, each beside its check SQL."""
