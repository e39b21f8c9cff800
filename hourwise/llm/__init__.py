"""Operators for preparing training data: token counts, decontamination, near duplicates, licences, toxicity,
secrets, languages, source mixing, line dedup and quality rules.

Nothing else in the library imports this subpackage. Every operator takes a DataFrame with an integer ``doc_id``
and a string ``text`` (``source``, ``lang`` where named), ignores all other columns, and treats a NULL text as
the empty text unless its docstring says otherwise.
"""
