"""Streaming: the reference processes one bounded file and has no stream, window, watermark or state.

Nothing is built here on purpose (see README, "Not built"). A fitted model from ``tabula.operators``
can score a Structured Streaming DataFrame directly (``model.transform`` on ``readStream`` input) since
every fitted preparation is a narrow projection.
"""
