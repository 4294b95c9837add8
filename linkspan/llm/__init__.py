"""Operators for preparing training data: ten of them, and what they share (``common``)."""
