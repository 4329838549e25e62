"""Query-log analytics, retrieval evaluation and corpus preparation as Spark plans."""
