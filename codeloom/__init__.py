"""codeloom: a Spark-native engine that treats source trees as relations."""
