"""Operators of the transcript analytics library."""
