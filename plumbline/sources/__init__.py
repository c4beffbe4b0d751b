"""Readers of source trees, history, diffs and build output."""
