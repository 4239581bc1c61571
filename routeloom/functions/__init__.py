"""Text, extraction and grading functions."""
