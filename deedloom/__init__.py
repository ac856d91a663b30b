"""deedloom: page text, register records and reports as Spark DataFrame operators."""

__version__ = "0.1.0"
