"""Training-data operators: filtering, fingerprints, deduplication, mixing, packing, classifiers, token counts.

Each module holds one operator with a general interface; ``catalog`` registers the thin queries. Nothing
outside this package imports it. Defined everywhere: null texts count as empty, extra columns are ignored
(their names cannot clash, because every operator first selects the columns it needs), an empty table gives
an empty result, and equal rows are treated as separate rows unless a docstring says otherwise.
"""
