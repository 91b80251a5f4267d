"""Operators for training data: neighbours, percentiles, packing, leakage and sentences. Nothing outside imports this package."""
