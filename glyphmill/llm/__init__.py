"""Training-data operators. Nothing outside this subpackage (and the entry module) imports it."""
