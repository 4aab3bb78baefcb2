"""PySpark operators for legacy-encoded text, document comparison, usage limits and activity analytics."""
