"""Part of refloom."""
