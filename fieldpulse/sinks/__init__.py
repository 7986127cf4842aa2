"""Sinks: message publishing, table appends, reports, summaries."""
