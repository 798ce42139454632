"""Reusable DataFrame operators: joins, searches, grouped statistics, reshaping."""
