"""Spark-first engine for embedding pipelines over large tiled images.

The optional subpackage for text corpora is imported by nothing in here.
"""

__version__ = "0.1.0"
