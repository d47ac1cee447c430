"""Whole checks, composed of operators."""
