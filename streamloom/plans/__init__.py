"""Compositions: the staged publish pipeline and the query catalogue."""
