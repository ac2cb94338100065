"""Operators of a large-scale training-data pipeline. Nothing else in vecmill imports them."""
