"""Operators that prepare text for training: cleaning, de-duplication, mixing, tokens, packing."""
