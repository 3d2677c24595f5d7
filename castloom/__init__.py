"""DataFrame operators for feed entries, transcripts, extraction results and notes."""
