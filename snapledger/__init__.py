"""snapledger: gated snapshot history and change intelligence on Spark."""

__version__ = "0.1.0"
