"""sources of matrixloom."""
