"""Operators for preparing training text: duplicates, extraction, scoring, quality, secrets, tokens.

Nothing outside this folder imports it, so that it can be taken away as a whole.
"""
