"""Column builders: regular expressions, offsets, checksums, hashes and text measures."""
