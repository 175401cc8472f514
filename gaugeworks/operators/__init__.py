"""Operators on raw, daily and live frames."""
