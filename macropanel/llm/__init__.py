"""Operators of a pipeline for training data: tokens, duplicates, quality, mixing, chat layouts."""
