"""textpace: reading analytics over tables of documents, pages, layouts and sessions."""
