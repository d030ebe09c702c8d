"""DataFrame in, DataFrame out. Each module covers one family of audit operators."""
