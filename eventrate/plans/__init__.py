"""Operators strung together: preparation plans and the query catalogue."""
