"""ledgerlake: block-metadata analytics over an append-only operation log, on Spark."""

__version__ = "0.1.0"
