"""Readers and writers. A reader is two steps: `lines` gives (set_id, line_no, value), and a parser works on such rows."""
