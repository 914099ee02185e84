"""Language-model evaluation as Spark DataFrame operators."""
