"""Configurations, runs and the registered queries."""
