"""Views of the supplied tables as the engine's domain tables, and the queries over them."""
