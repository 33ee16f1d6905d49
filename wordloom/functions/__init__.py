"""Column functions: measures and text transformations."""
