"""Set-at-a-time operators over corpora, chunks, postings, vectors and verdicts."""
