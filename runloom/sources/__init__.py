"""Readers of labelled array datasets and of event logs."""
