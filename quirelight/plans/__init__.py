"""Part of quirelight: plans."""
