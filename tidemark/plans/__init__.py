"""Composite jobs (the user-facing API) and the registered query catalog."""
