"""Part of quarrymill."""
