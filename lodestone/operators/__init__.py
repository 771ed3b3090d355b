"""Relational operators over the entry relation."""
