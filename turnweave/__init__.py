"""turnweave: Spark-first analytics for labelled time spans, word streams and vectors."""

__version__ = "0.1.0"
