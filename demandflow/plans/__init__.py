"""Forecasts and production plans composed of the operators."""
