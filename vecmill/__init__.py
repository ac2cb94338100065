"""vecmill: vector quantization, retrieval analytics and nearest-neighbour search on Spark."""

__version__ = "0.1.0"
