"""Evaluators of trained models over columns."""
