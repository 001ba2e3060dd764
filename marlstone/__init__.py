"""marlstone: sparse linear algebra and data preparation as Spark dataflow."""
