"""A code-graph analytics engine on the DataFrame API."""
