"""Sections, reports, gates and the command line."""
