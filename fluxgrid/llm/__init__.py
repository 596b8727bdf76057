"""Training-data operators over a table of documents. Nothing outside this subpackage imports it."""
