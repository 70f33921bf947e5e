"""Analytics for ledgers of transaction outputs, on Spark."""
