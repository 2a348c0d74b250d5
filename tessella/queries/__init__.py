"""Registered queries over the standard tables, each with SQL where SQL can express it."""
