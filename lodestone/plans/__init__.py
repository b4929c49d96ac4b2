"""Responses and the facade that ties definitions, builds, publication and queries together."""
