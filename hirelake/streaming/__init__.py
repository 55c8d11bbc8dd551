"""The daily run on a stream of listings."""
