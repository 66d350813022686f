"""Functions that build Spark column expressions."""
