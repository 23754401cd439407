"""Model tables over the given data and the end-to-end plans."""
