"""Pure DataFrame operators over the pool model (catalog, journal, blobs)."""
