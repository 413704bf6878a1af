"""Operators of a training-data pipeline: mixing, archives, secrets, quality, near copies, languages, chats, tokens."""
