"""Graph, region and overlay sources and sinks."""
