"""Literature analytics on Spark: lazy DataFrame operators over explicit relations."""

__version__ = "0.1.0"
