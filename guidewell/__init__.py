"""Perturbation scores for single-cell screens as Spark DataFrame plans."""
