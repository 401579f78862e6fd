"""planmatch: reconciles noisy asset identifiers with an authoritative catalog, on Spark."""
