"""Operators for preparing training text at scale: counting, filtering, de-duplicating, reading and scoring documents and pages.

Nothing else in the library imports this subpackage.
"""
