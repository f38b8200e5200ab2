"""Query plans: end-to-end compositions and the registered query catalog."""
