"""Sources: the test tables and the mutation logs derived from them."""
