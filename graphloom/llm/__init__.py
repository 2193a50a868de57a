"""Training-data operators; one module per operator, its registered query in `queries`."""
