"""streaming of matrixloom."""
