"""DataFrame operators over the logical relations of the community."""
