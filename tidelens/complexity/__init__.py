"""Per-function code complexity without a parser library: a lexer and a block walker per language family."""
