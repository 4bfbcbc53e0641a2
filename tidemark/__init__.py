"""tidemark: change logs and click events to governed, query-ready tables on Spark."""
