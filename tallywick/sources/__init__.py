"""Readers and writers: payloads, labelled vectors, parameters, indexes, and the transaction fixture."""
