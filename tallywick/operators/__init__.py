"""Operators: features, neighbours, index building, probing, policy and decisions."""
