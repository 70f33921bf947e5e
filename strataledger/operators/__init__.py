"""Operators over ledgers and histories."""
