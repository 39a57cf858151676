"""Code-graph analytics and corpus operators as PySpark DataFrame programs."""

__version__ = "0.2.0"
