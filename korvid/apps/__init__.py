"""Applications over the operators: a shop with recommendations, a passage assistant."""
