"""pairmill: curation of instruction-tuning pairs as Spark DataFrame jobs."""
