"""Streaming use.

There is no stateful streaming job in this library.  The row-wise operators
(filters, labels, salt stripping, fingerprints, hash splits) hold no state and
take a streaming DataFrame as they are; ``tests/test_streaming.py`` runs them so.
"""
