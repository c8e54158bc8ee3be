"""Operators for preparing training text: one module for each, and `queries` with their registered queries."""
