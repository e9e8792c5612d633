"""Part of callweave."""
