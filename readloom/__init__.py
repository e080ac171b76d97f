"""readloom: quality control of aligned sequencing reads, and text corpora, as Spark jobs."""

__version__ = "0.3.0"
