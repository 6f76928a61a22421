"""kinweave: record linkage and corpus analytics expressed as Spark plans."""
