"""A Spark-native engine for nucleotide k-mer data."""
