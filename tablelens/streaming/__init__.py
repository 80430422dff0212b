"""Streaming.

The analysed system has no streams: no watermark, window, stateful operator
or late data; every analysis step is a batch job over one table. Nothing is
mapped to Structured Streaming. A table that grows can be profiled per
micro-batch by calling the batch operators inside ``foreachBatch`` and
appending the findings with ``tablelens.sources.sinks.append_findings``
(append mode, one partition per run), which is the only streaming-shaped use
this library supports.
"""
