"""Operators of a training-data pipeline: tokens, chat, quality, privacy, search, links, packing."""
