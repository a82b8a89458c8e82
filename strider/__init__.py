"""Motion-data analytics on Spark: DataFrame operators over clip, frame and joint layouts."""

__version__ = "0.1.0"
