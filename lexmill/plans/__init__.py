"""Lexmill plans."""
