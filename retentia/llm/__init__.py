"""Operators for preparing training text: tokens, copies, secrets, quality, neighbours, chats, packing.

Each module holds one operator with its own interface; ``queries`` registers them over the whole
``documents``, ``embeddings`` and ``conversations`` tables. Nothing outside this package imports it.
"""
