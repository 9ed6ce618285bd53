"""Graph and text analytics expressed as Spark DataFrame operators."""
