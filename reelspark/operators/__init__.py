"""DataFrame operators over ordered timelines."""
