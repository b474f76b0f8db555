"""Training-data operators for corpora of any size; nothing else in the package imports this."""
