"""Structured Streaming: ingestion of statements and running balances across batches."""
