"""Lexmill operators."""
