"""DataFrame operators: detection, resolution, rewriting, matching and evaluation."""
