"""Training-data operators: ten corpus operators, one module each, and their queries."""
