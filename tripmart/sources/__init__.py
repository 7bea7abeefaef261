"""Sources: monthly trip files, catalog inventory, query reads, test adapter."""
