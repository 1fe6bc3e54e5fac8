"""E-mail forensics and mail-corpus processing, declared as Spark DataFrame plans."""

__version__ = "0.1.0"
