"""factloom: a Spark-native engine for graded, traceable evidence."""
