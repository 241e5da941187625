"""Options and end-to-end flows composed from the operators."""
