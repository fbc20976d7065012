"""operators of matrixloom."""
