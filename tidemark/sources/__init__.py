"""Reading boards: transport, parsing of recorded responses, and mapping to postings."""
