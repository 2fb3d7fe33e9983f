"""Training-data operators on texts. Nothing outside this subpackage imports it."""
