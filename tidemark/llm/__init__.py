"""Operators of a training-data pipeline over text, chats and web pages."""
