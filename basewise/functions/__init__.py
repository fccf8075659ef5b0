"""Part of basewise."""
