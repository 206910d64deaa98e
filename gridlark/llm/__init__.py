"""Operators for preparing language-model training data, one module each.

Nothing outside this subpackage imports it.  ``registry`` names the ``opN_*``
queries and their SQL; the operators keep general interfaces.
"""
