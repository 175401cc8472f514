"""Gauge time-series analytics on Spark DataFrames.

Every public function takes and returns DataFrames keyed by
``(station_id, parameter)`` and builds a lazy plan; nothing is collected.
"""
