"""Subpackage of quire."""
