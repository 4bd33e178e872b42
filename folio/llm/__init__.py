"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. ``folio.llm.queries`` holds
the registered queries; every operator module can be used on its own.
"""
