"""Siltstone: DataFrame operators for corpora of labelled outcomes, text revisions, vectors and event journals."""
