"""Readers and writers: recordings, session documents, logs, control messages, vocabularies, payloads."""
