"""Operators for large training corpora: linking, scoring, filtering, matching.

Every module holds one operator as a ``DataFrame -> DataFrame`` function; the
registered ``opN_<name>`` queries are in ``prefsight.llm.queries``.  Nothing
else in the library imports this package.
"""
