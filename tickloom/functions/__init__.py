"""Column helpers and the window layouts every operator builds on."""
