"""Operators for training-data pipelines; nothing else in lattica imports this."""
