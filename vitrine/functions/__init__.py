"""Column builders; none of them runs Python on executors unless its docstring says so."""
