"""Part of quirelight: functions."""
