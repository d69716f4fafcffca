"""Readers and writers: chat exports, transcriptions, reference tables, the experiment log, index tables."""
