"""Readers and writers of complaint, prediction and notification tables."""
