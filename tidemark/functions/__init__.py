"""Column functions: text cleaning, defaults, arithmetic of times, costs and vectors."""
