"""Column functions; they compose inside whole-stage code generation unless noted."""
