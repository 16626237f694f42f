"""Clinical-event timeline engine on Spark DataFrames."""

__version__ = "0.1.0"
