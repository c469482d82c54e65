"""Layer plans and the models built from them."""
