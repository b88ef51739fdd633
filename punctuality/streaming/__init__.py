"""The scoring plan on a stream of requests."""
