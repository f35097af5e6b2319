"""Column functions: hashing, wildcard matching, identifiers, JSON keys."""
