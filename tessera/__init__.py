"""tessera: document-corpus ingest, hybrid retrieval and operational analytics on Spark."""
