"""DataFrame → DataFrame operators, grouped by the part of the product they serve."""
