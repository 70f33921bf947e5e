"""Ledgers kept up by streams of batches."""
