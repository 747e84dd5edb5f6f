"""Table scans, upload triage, the run store and report sinks."""
