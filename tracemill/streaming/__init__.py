"""Stream sources, sinks and stateful operators."""
