"""Brindle: DataFrame operators for preparing, clustering, splitting and evaluating scientific tables."""
