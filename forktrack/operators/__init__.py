"""Relational operators on calls, segments and forks."""
