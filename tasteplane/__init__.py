"""tasteplane: taste analytics over rating libraries and credit graphs, declared as Spark plans."""

__version__ = "0.1.0"
