"""Operators for training-data pipelines, each by the method its module describes."""
