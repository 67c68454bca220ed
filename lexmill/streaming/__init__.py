"""Lexmill streaming."""
