"""Operators that prepare text, vectors and chats for the training of language models."""
