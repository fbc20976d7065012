"""plans of matrixloom."""
