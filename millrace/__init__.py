"""Forum-thread curation, reward scoring and evaluation as Spark DataFrame operators."""
