"""Composed plans: site-model tables and the registered queries."""
