"""turnwise: conversation and prediction analytics expressed as Spark DataFrame plans."""
