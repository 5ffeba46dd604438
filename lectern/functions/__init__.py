"""Column functions: cleaning, splitting, vectors and scores."""
