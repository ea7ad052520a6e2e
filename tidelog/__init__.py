"""tidelog: a Spark-native engine for ordered, versioned mutation logs."""
