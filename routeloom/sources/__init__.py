"""Readers of tasks, rewards and catalogues, and mappers of benchmark rows."""
