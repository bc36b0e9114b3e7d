"""Operators over DataFrames of items, predictions, events, frames and annotations."""
