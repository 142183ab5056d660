"""Operators on text: packing into containers, leaked test passages, quality statistics."""
