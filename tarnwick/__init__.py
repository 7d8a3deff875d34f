"""tarnwick: code and text retrieval, and its evaluation, as Spark DataFrame plans."""

__version__ = "0.1.0"
