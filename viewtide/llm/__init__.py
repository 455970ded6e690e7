"""Operators of training-data pipelines: each in a module of its own, with its query; registry has all of them."""
