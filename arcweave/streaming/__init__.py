"""Graph tables that follow a stream of edges."""
