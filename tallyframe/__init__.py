"""Tallyframe: composable PySpark operators for ordered event tables."""
