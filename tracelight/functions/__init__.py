"""Column functions: all are expressions of built-in functions unless a name says otherwise."""
