"""Structured Streaming: fetch results into the store, and the circuit breaker kept as state."""
