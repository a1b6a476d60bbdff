"""folio: document-flow analytics on Spark DataFrames."""
