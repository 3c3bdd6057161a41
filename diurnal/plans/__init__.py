"""Builds and analyses: compositions of the operators."""
