"""Relational operators over any DataFrame with sort keys."""
