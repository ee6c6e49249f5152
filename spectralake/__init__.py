"""Spark jobs for multichannel time series kept as tables, and for building training sets."""
