"""Column-level helpers: hashing, SQL rendering and scoring expressions."""
