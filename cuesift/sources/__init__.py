"""Readers and writers: captions, vocabularies, weights, vector indexes."""
