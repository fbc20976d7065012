"""functions of matrixloom."""
