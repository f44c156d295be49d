"""A front end for Go source: tokens, syntax nodes, and facts derived from them."""
