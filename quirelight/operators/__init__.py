"""Part of quirelight: operators."""
