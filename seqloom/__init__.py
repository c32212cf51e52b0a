"""seqloom: a Spark-first engine for sequence-centred feature tables."""
