"""Plan-level helpers: shared folders, materialised cuts, size-checked broadcasts."""
