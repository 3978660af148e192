"""Column functions over text and scores."""
