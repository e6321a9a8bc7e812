"""Part of the catalog analytics library."""
