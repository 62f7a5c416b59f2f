"""Training-data operators: sharding, decontamination, deduplication, scoring, tokens and privacy.

Nothing outside this subpackage imports it. Every operator reads only the
columns it is told to read and returns its key with its own result columns, so
further columns of the input, whatever they are called, can never clash.
"""
