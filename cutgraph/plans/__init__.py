"""From a request to a timeline: retrieval, selection, planning, checks and reports."""
