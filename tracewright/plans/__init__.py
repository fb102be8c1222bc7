"""Registered queries by family, each with its SQL where SQL can express it."""
