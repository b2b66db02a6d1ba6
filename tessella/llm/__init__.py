"""Training-data operators: token files, PII, SentencePiece, fingerprints, near-duplicates,
WARC, language ID, decontamination, LM scoring and secret scans."""
