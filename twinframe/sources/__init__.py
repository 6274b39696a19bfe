"""Reading and writing datasets, metadata, results and ids."""
