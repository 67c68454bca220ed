"""Lexmill functions."""
