"""Structured Streaming forms of the operators and the incremental batch jobs behind them."""
