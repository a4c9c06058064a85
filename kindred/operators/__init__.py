"""DataFrame operators of the linkage pipeline."""
