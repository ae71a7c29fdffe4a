"""Readers and writers: page text and JSON, archives, prepared text, clippings, DOCX, decisions, truth."""
