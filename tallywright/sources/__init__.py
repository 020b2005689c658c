"""Question sets, recorded responses, fact tables and result sinks."""
