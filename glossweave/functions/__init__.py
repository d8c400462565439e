"""Part of glossweave."""
