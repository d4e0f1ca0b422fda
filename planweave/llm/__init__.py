"""Operators on training data: groups, name variants, pieces, copies, look-alikes, encoding, packing, moderation."""
