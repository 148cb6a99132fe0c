"""How given tables become this library's model."""
