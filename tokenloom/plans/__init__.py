"""Jobs composed of the operators: the corpus store, and the registered queries."""
