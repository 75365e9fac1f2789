"""Training-data operators over corpora of text; nothing else in the library imports this subpackage."""
