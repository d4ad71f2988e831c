"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it.  ``queries.py`` registers one thin
``opN_<name>`` query for each operator.
"""
