"""Column functions: identifiers, object parsing, rendering."""
