"""clearwell: table cleaning, quality measurement and run reporting on Spark DataFrames."""

__version__ = "0.1.0"
