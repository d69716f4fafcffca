"""Relational operators of the workbench."""
