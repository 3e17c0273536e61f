"""cladeforge: a Spark-native engine for k-mer profiling against a reference tree."""
