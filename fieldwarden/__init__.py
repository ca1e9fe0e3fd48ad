"""Rule-driven data validation, audit and corpus operators on Spark."""
