"""Temporal, multimodal memory retrieval on Spark."""
