"""Market-bar research and risk analytics as Spark DataFrame operators."""
