"""Scoring with a small acoustic model in Arrow batches; training is out of scope."""
