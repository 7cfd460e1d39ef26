"""factlode: evidence-carrying document and figure analytics as Spark plans."""

__version__ = "0.1.0"
