"""Registered queries; importing the package registers all of them."""

from . import basic, classification, learning, spatial  # noqa: F401
from .registry import QUERIES, oracles  # noqa: F401
