"""Operators for building training corpora: fingerprints, filters, dedup, mixing and packing.

Nothing else in the library imports this subpackage.  Shared conventions:

* an operator takes a DataFrame and column names, reads only those columns (so extra
  columns with any name are harmless) and keeps no state between calls;
* a null text counts as the empty text, a null id is an id of its own that sorts first;
* repeated rows are rows of their own: none is dropped and each gets a result.
"""
