"""Operators for text that models are trained on. Nothing else in the library imports this."""
