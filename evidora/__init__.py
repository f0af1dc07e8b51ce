"""evidora: retrieval and evidence analytics over text streams, built on PySpark."""
