"""Column functions over posting fields."""
