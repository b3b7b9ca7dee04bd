"""Column functions: parsing of dirty text, geometry, binning. All are built-in expressions."""
