"""barlab: market-bar analytics as composable Spark DataFrame operators."""
