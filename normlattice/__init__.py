"""normlattice: Spark-native alignment of normative texts and its evaluation."""
