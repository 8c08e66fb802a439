"""Training-data operators. Nothing else in panelforge imports this package."""
