"""driftnote: event detection and data processing over dated text, on Spark."""

__version__ = "0.1.0"
