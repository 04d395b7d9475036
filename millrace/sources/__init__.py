"""Where tables come from and go to: the versioned store, its log, generators, documents, blobs."""
