"""Operators for large training corpora: scoring, filtering, deduplication, packing and output.

Rules that hold in every module:

* Only the named columns are read, so other columns of any name do no harm.
* A null text counts as an empty one. A null id is kept as a row of its own value.
* Rows that repeat a ``doc_id`` are each answered; where a result is per
  document, rows with one id share it.
* An empty table gives an empty result with the same columns.
"""
