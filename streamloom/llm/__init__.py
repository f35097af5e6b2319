"""Operators for preparing training corpora at scale.

Nothing else in the library imports this subpackage.  Each module holds one operator with a
general interface; ``queries`` registers the thin ``opN_*`` queries built from them.
"""
