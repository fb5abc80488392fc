"""Readers of the supported inputs and writers of the outputs."""
