"""Multi-operator pipelines."""
