"""Following a stream of documents into a store."""
