"""Whole evaluations made of the operators."""
