"""DataFrame in, DataFrame out. No operator runs an action unless its docstring says so."""
