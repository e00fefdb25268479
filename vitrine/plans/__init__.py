"""Session settings and paging."""
