"""Streams: there is no stateful operator here.

Every column function and every per-row operator of this library (harmonising,
coercion, filters, references, previews) is a projection or a filter and so
works on a streaming frame as it is.
"""
