"""Part of foliant."""
