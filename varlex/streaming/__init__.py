"""Incremental upkeep of the store from a landing folder."""
