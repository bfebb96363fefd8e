"""Relational operators over alert, rule, mute and history DataFrames."""
