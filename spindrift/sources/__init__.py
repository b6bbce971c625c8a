"""Reading and writing: manifests, pages, articles, chunks, gold items, results."""
