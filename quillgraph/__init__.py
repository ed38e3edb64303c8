"""quillgraph: a Spark-native engine for building and querying licence-aware text corpora."""
