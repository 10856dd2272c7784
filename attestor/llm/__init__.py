"""Operators for training data: personal data, duplicates, contamination, quality, archives, chats, mixing."""
