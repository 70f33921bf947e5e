"""Where ledgers come from."""
