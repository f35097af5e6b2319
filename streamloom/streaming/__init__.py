"""The continuous forms of the windowed, joining and deduplicating operators."""
