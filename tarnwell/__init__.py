"""tarnwell: evidence-driven classification of file collections on PySpark."""

__version__ = "0.1.0"
