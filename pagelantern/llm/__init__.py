"""Operators for training-data pipelines; nothing else in pagelantern imports this subpackage."""
