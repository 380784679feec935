"""Operators over DataFrames: joins, roll-ups, windows, ordering, merges, matching."""
