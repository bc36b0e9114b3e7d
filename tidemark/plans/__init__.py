"""Views and the query catalogue."""
