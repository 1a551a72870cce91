"""Corpus preparation operators for training data: thirteen operators, their queries and a pipeline."""
