"""Sources and sinks: the standard tables, listings of boards, and idempotent writes."""
