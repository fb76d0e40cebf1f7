"""Streaming form of the control build: sites leave once every sample has passed them."""
