"""Relational operators over tasks, calls and rewards."""
