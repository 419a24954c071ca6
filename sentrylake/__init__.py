"""sentrylake: security analytics expressed as Spark DataFrame operators."""
