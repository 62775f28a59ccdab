"""leafsift: hybrid retrieval and corpus preparation for medicine leaflets, on Spark."""
