"""Operators for preparing language-model training data. Nothing else in codeloom imports this package."""
