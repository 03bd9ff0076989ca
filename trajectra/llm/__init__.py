"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` registers one query per
operator on the driver's tables.
"""
