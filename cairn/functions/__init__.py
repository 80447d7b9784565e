"""Column builders: cleaning, classification, scaling, ranking."""
