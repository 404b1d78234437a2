"""Training-data operators: packing, token output, token counts, near and exact
de-duplication, document sketches, language ID, license scans, source mixing, sharding, conversation repair and filter audits.

Nothing else in the library imports this package. Every operator takes a DataFrame with
at least ``doc_id`` and ``text`` (``conv_id, turn, role, text`` for conversations), reads only the columns it names (other columns, whatever
they are called, never clash with its own), and returns a DataFrame. A null text counts as
the empty text; an empty table gives an empty result with the same columns.
"""
