"""talkweave: a Spark-native engine for conversation and document analytics."""
