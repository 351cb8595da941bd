"""Scenario relations and the registered queries."""
