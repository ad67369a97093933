"""Ways of laying out work that a plain plan would bring into one task."""
