"""Operators on text and entities for preparing training data.

Nothing outside this folder imports it.
"""

from touchline.llm.queries import registry

__all__ = ["registry"]
