"""Condition histories of long-lived assets as composable Spark DataFrame operators."""
