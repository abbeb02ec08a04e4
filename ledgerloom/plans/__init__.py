"""Plan fragments several operators are built from."""
