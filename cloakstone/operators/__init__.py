"""Classification, de-identification, verification, leak scans, event merge, audit, statistics."""
