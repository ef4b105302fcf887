"""Labelled-text datasets, classifier evaluation and training-run analytics on Spark."""
