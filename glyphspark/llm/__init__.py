"""Operators for preparing training corpora; see each module's docstring for its contract."""
