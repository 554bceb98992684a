"""Operators for preparing training text: tokens, pages, archives, languages, duplicates, leaks and secrets.

Nothing outside this folder imports it.  Each module holds one operator; ``queries`` registers them.
"""
