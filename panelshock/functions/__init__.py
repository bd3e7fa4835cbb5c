"""Column functions and small relational helpers."""
