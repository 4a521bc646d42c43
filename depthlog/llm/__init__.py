"""Operators for training-data corpora: one module per operator, their registered queries in `queries`."""
