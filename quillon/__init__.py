"""quillon: document analytics and retrieval operators as Spark DataFrame plans."""

__version__ = "0.1.0"
