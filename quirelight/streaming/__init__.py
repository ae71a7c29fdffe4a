"""Part of quirelight: streaming."""
