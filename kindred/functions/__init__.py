"""Column builders: cleaning transforms, comparison features, comparison trees, string similarity."""
