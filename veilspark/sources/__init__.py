"""Where fragments, labels and presets come from."""
