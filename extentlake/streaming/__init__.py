"""Stateful operators: batch folds and Structured Streaming."""
